"""Entities of C# files, read off the lexer's tokens."""

from __future__ import annotations

import re

from .lexer import Source, complexity
from .stoplists import CSHARP_BUILTINS

_STOP = frozenset(CSHARP_BUILTINS)
_MODIFIERS = {"public", "private", "protected", "internal", "static", "abstract", "sealed", "partial", "virtual", "override", "async", "readonly", "const", "extern", "unsafe", "new", "volatile", "required"}
_OPEN_TO_OTHERS = {"public", "protected", "internal"}
_KEYWORDS = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "new", "nameof", "typeof", "sizeof", "when", "fixed", "default", "throw", "await", "base", "this"}


class Module:
    def __init__(self, path: str, code: str):
        self.path, self.s = path, Source(code, verbatim=True)
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.interfaces: list[dict] = []
        self.types: list[dict] = []
        self.variables: list[dict] = []
        self.imports: list[dict] = []
        self.calls: list[dict] = []
        self.components, self.renders = [], []
        self._members(0, len(self.s.tokens) - 1, None)

    def _members(self, k: int, end: int, owner: str | None) -> None:
        s = self.s
        while k <= end:
            first = k
            while s.text(k) == "[" and k in s.match:  # attributes
                k = s.match[k] + 1
            start, words = k, set()
            while s.text(k) in _MODIFIERS and k <= end:
                words.add(s.text(k))
                k += 1
            t = s.text(k)
            if t == "using" and owner is None and not words:
                k = self._using(k)
            elif t == "namespace":
                while k <= end and s.text(k) not in ("{", ";"):
                    k += 1
                if s.text(k) == "{" and k in s.match:
                    self._members(k + 1, s.match[k] - 1, None)
                    k = s.match[k]
                k += 1
            elif t in ("class", "struct", "record", "interface") and s.kind(k + 1) == "word":
                k = self._type(k, start, words, end)
            elif t in ("enum", "delegate"):
                k = self._enum(k, start, words)
            elif owner and k <= end:
                k = self._member(k, start, words, owner, end)
            else:
                k += 1
            k = max(k, first + 1)

    def _lines(self, a: int, b: int) -> dict:
        s = self.s
        return {"file_path": self.path, "start_line": s.tokens[a].line, "end_line": s.tokens[min(b, len(s.tokens) - 1)].line}

    def _using(self, k: int) -> int:
        s, a = self.s, k + 1
        a += s.text(a) == "static"
        alias = s.text(a) if s.text(a + 1) == "=" else None
        a += 2 if alias else 0
        b = a
        while b < len(s.tokens) and s.text(b) != ";":
            b += 1
        self.imports.append({"file_path": self.path, "source": s.span(a, b - 1), "line": s.tokens[k].line, "is_default": False, "is_namespace": True, "specifiers": [], "namespace_alias": alias, "default_alias": None, "resolved_path": None})
        return b + 1

    def _type(self, k: int, start: int, words: set[str], end: int) -> int:
        s, kind = self.s, self.s.text(k)
        k += 1
        if kind == "record" and s.text(k) in ("class", "struct"):
            k += 1
        name, bases, depth, seen = s.text(k), [], 0, False
        j = k + 1
        while j <= end and s.text(j) not in ("{", ";"):
            if s.text(j) == "(" and j in s.match:
                j = s.match[j]
            depth += (s.text(j) == "<") - (s.text(j) == ">")
            if s.text(j) == "where" and not depth:
                while j <= end and s.text(j) not in ("{", ";"):
                    j += 1
                break
            if s.text(j) == ":" and not depth:
                seen = True
            elif seen and not depth and s.kind(j) == "word" and s.text(j - 1) in (":", ","):
                e = j
                while s.text(e + 1) == ".":
                    e += 2
                bases.append(s.span(j, e))
            j += 1
        close = s.match.get(j, j)
        row = {"name": name, "is_exported": bool(words & _OPEN_TO_OTHERS), "docstring": None} | self._lines(start, close)
        if kind == "interface":
            self.interfaces.append(row | {"extends": bases})
        else:
            faces = [b for b in bases if re.match("I[A-Z]", b.split(".")[-1])]
            others = [b for b in bases if b not in faces]
            self.classes.append(row | {"is_abstract": "abstract" in words, "extends": others[0] if others else None, "implements": faces + others[1:]})
        if s.text(j) == "{" and j in s.match:
            self._members(j + 1, s.match[j] - 1, name)
        return close + 1

    def _enum(self, k: int, start: int, words: set[str]) -> int:
        s, kind = self.s, self.s.text(k)
        j = k + 1
        if kind == "delegate":
            while j < len(s.tokens) and s.text(j) != "(":
                j += 1
            name, end = s.text(j - 1), s.match.get(j, j) + 1
        else:
            name = s.text(j)
            while j < len(s.tokens) and s.text(j) != "{":
                j += 1
            end = s.match.get(j, j)
        self.types.append({"name": name, "kind": "enum" if kind == "enum" else "type", "is_exported": bool(words & _OPEN_TO_OTHERS), "docstring": None} | self._lines(start, end))
        return end + 1

    def _member(self, k: int, start: int, words: set[str], owner: str, end: int) -> int:
        """A method, constructor, field or property."""
        s, j, depth = self.s, k, 0
        while j <= end and not (not depth and s.text(j) in ("(", "{", ";", "=", "=>")):
            depth += (s.text(j) == "<") - (s.text(j) == ">")
            j = s.match.get(j, j) if s.text(j) == "[" else j
            j += 1
        name_at = j - 1
        if s.text(name_at) == ">":
            while name_at > k and s.text(name_at) != "<":
                name_at -= 1
            name_at -= 1
        if j > end or s.kind(name_at) != "word":
            return j + 1
        name, kind = s.text(name_at), s.span(k, name_at - 1) if name_at > k else None
        exported = bool(words & _OPEN_TO_OTHERS)
        if s.text(j) == "(" and j in s.match:
            b = s.match[j] + 1
            while b <= end and s.text(b) not in ("{", ";", "=>"):
                b = s.match.get(b, b) + 1 if s.text(b) == "(" else b + 1
            if s.text(b) == "{" and b in s.match:
                body, close = (b + 1, s.match[b] - 1), s.match[b]
            elif s.text(b) == "=>":
                close = s.expression_end(b + 1) + 1
                body = (b + 1, close - 1)
            else:
                body, close = (1, 0), min(b, end)
            params = []
            for x, y in s.split(j + 1, s.match[j] - 1):
                default = next((i for i in range(x, y + 1) if s.text(i) == "="), None)
                stop = (default or y + 1) - 1
                params.append({"name": s.text(stop), "type": s.span(x, stop - 1) if stop > x else None, "optional": default is not None, "defaultValue": s.span(default + 1, y) if default else None, "isRest": s.text(x) == "params"})
            cyclomatic, cognitive, nesting = complexity(s, *body)
            row = {
                "name": name, "is_exported": exported, "is_async": "async" in words, "is_arrow": False, "params": params, "return_type": None if name == owner else kind, "docstring": None,
                "complexity": cyclomatic, "cognitive_complexity": cognitive, "nesting_depth": nesting,
            } | self._lines(start, close)
            self.functions.append(row)
            for x in range(body[0], body[1] + 1):
                if s.text(x) == "(" and s.kind(x - 1) == "word" and s.text(x - 1) not in _KEYWORDS | _STOP and s.text(x - 2) != "new":
                    self.calls.append({"file_path": self.path, "caller": name, "caller_line": row["start_line"], "callee": s.text(x - 1), "line": s.tokens[x - 1].line})
            return close + 1
        if kind:
            constant = "const" if words & {"const", "readonly"} else "let"
            self.variables.append({"name": name, "file_path": self.path, "line": s.tokens[start].line, "kind": constant, "is_exported": exported, "type": kind})
        if s.text(j) == "{" and j in s.match:
            j = s.match[j]
            if s.text(j + 1) != "=":
                return j + 1
            j += 1
        return s.expression_end(j + 1) + 2 if s.text(j) in ("=", "=>") else j + 1
