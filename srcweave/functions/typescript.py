"""Entities of TypeScript and JavaScript files, read off the lexer's tokens."""

from __future__ import annotations

import re

from .lexer import Source, complexity
from .stoplists import JS_BUILTINS

_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "override", "abstract", "get", "set", "declare", "accessor"}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "throw", "super", "constructor?", "do", "else", "case", "in", "of", "with"}
_STOP = frozenset(JS_BUILTINS)


def _unquote(x: str) -> str:
    return x[1:-1] if len(x) > 1 and x[0] in "'\"`" else x


class Module:
    """One file's entities: lists of dicts with the columns of the model."""

    def __init__(self, path: str, code: str):
        self.path, self.s = path, Source(code)
        self.exports = self._exported()
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.interfaces: list[dict] = []
        self.types: list[dict] = []
        self.variables: list[dict] = []
        self.imports: list[dict] = []
        self._bodies: list[tuple[int, int, dict]] = []
        self._walk()
        self.functions.sort(key=lambda f: (f["start_line"], f["name"]))
        self.components = [c for a, b, f in self._bodies if (c := self._component(a, b, f))]
        self.calls = [dict(r, file_path=path) for a, b, f in self._bodies for r in self._calls(a, b, f)]
        self.renders = [dict(r, file_path=path) for a, b, f in self._bodies for r in self._renders(a, b, f)]

    # exports ------------------------------------------------------------------------------------------------------
    def _exported(self) -> list[tuple[int, int]]:
        s, out, k = self.s, [], 0
        while k < len(s.tokens):
            if s.text(k) == "export" and s.kind(k) == "word" and s.text(k - 1) != ".":
                out.append((k, self._statement_end(k + 1)))
            k += 1
        return out

    def _statement_end(self, k: int) -> int:
        """The last token of the statement at k: its block's end for declarations, else the end of the line's expression."""
        s = self.s
        while s.text(k) in ("default", "async", "declare", "abstract"):
            k += 1
        if s.text(k) in ("function", "class", "interface", "enum", "namespace"):
            while k < len(s.tokens) and s.text(k) != "{":
                k = s.match[k] + 1 if s.text(k) in ("(", "[") and k in s.match else k + 1
            return s.match.get(k, len(s.tokens) - 1)
        while k < len(s.tokens) and s.text(k) != ";":
            if s.text(k) in ("(", "[", "{") and k in s.match:
                k = s.match[k]
            nxt = k + 1
            if nxt < len(s.tokens) and s.tokens[nxt].line > s.tokens[k].line and s.kind(nxt) == "word" and (s.kind(k) != "sign" or s.text(k) in (")", "]", "}")):
                return k
            k += 1
        return min(k, len(s.tokens) - 1)

    def _is_exported(self, k: int) -> bool:
        return any(a <= k <= b for a, b in self.exports)

    # one pass over the tokens ---------------------------------------------------------------------------------------
    def _walk(self) -> None:
        s, k = self.s, 0
        while k < len(s.tokens):
            t, word = s.text(k), s.kind(k) == "word" and s.text(k - 1) not in (".", "?.")
            if word and t == "import" and s.text(k + 1) not in ("(", "."):
                self._import(k)
            elif word and t == "function":
                self._function(k)
            elif word and t == "class" and s.text(k + 1) != ":":
                self._class(k)
            elif word and t == "interface" and s.kind(k + 1) == "word":
                self._interface(k)
            elif word and t == "type" and s.kind(k + 1) == "word" and s.text(k + 2) in ("=", "<"):
                self._type(k, "type")
            elif word and t == "enum" and s.kind(k + 1) == "word":
                self._type(k, "enum")
            elif word and t in ("const", "let", "var") and s.text(k + 1) != "enum":
                self._variables(k)
            elif s.kind(k) == "sign" and t == "=>":
                self._arrow(k)
            k += 1

    def _first(self, k: int, words: tuple[str, ...]) -> int:
        """The first token of a declaration with such words before it."""
        while self.s.text(k - 1) in words and self.s.kind(k - 1) == "word":
            k -= 1
        return k

    def _import(self, k: int) -> None:
        s = self.s
        row = {"file_path": self.path, "line": s.tokens[k].line, "is_default": False, "is_namespace": False, "specifiers": [], "namespace_alias": None, "default_alias": None, "resolved_path": None}
        j = k + 1
        if s.text(j) == "type" and s.text(j + 1) != "from":
            j += 1
        if s.kind(j) == "word":
            row["is_default"], row["default_alias"] = True, s.text(j)
            j += 2 if s.text(j + 1) == "," else 1
        if s.text(j) == "*":
            row["is_namespace"], row["namespace_alias"] = True, s.text(j + 2)
            j += 3
        elif s.text(j) == "{":
            for a, b in s.split(j + 1, s.match.get(j, j + 1) - 1):
                if s.text(a) == "type" and b > a and s.text(a + 1) != "as":
                    a += 1
                row["specifiers"].append({"name": s.text(a), "alias": s.text(b) if b - a == 2 and s.text(a + 1) == "as" else None})
            j = s.match.get(j, j) + 1
        if s.text(j) == "from":
            j += 1
        if s.kind(j) == "string":
            self.imports.append(row | {"source": _unquote(s.text(j))})

    def _params(self, a: int, b: int) -> list[dict]:
        """Parameters between two brackets a and b."""
        s, out = self.s, []
        for x, y in s.split(a + 1, b - 1):
            while s.text(x) in _MODIFIERS and x < y and s.kind(x + 1) == "word":
                x += 1
            rest = s.text(x) == "..."
            x += rest
            skip = s.match.get(x, x)
            default = next((k for k in range(skip, y + 1) if s.text(k) == "="), None)
            stop = (default or y + 1) - 1
            colon = next((k for k in range(skip, stop + 1) if s.text(k) == ":"), None)
            name_end = (colon or stop + 1) - 1
            optional = s.text(name_end) == "?"
            out.append({
                "name": s.span(x, name_end - optional), "type": s.span(colon + 1, stop) if colon else None, "optional": optional or default is not None,
                "defaultValue": s.span(default + 1, y) if default else None, "isRest": bool(rest),
            })
        return out

    def _add(self, name: str, first: int, body: tuple[int, int], end: int, params: list[dict], returns: str | None, is_async: bool, arrow: bool) -> None:
        s = self.s
        cyclomatic, cognitive, nesting = complexity(s, *body)
        doc = s.docs.get(self._first(first, ("export", "default")), s.docs.get(first))
        row = {
            "name": name, "file_path": self.path, "start_line": s.tokens[first].line, "end_line": s.tokens[end].line, "is_exported": self._is_exported(first),
            "is_async": is_async, "is_arrow": arrow, "params": params, "return_type": returns, "docstring": doc, "complexity": cyclomatic,
            "cognitive_complexity": cognitive, "nesting_depth": nesting,
        }
        self.functions.append(row)
        self._bodies.append((body[0], body[1], row))

    def _returns(self, close: int, stop: tuple[str, ...]) -> tuple[str | None, int]:
        """(return type after a bracket, the token after it)."""
        s, k = self.s, close + 1
        if s.text(k) != ":":
            return None, k
        start = k = k + 1
        while k < len(s.tokens) and not (s.text(k) in stop and not (s.text(k) == "{" and k == start)):
            k = s.match.get(k, k) + 1 if s.text(k) in ("(", "[", "{") else k + 1
        return s.span(start, k - 1), k

    def _function(self, k: int) -> None:
        s = self.s
        j = k + 1 + (s.text(k + 1) == "*")
        name = s.text(j) if s.kind(j) == "word" else self._assigned(self._first(k, ("async",)))
        while j < len(s.tokens) and s.text(j) != "(":
            j += 1
        close = s.match.get(j)
        if not name or close is None:
            return
        returns, body = self._returns(close, ("{", ";"))
        if s.text(body) == "{" and body in s.match:
            first = self._first(k, ("async",))
            self._add(name, first, (body + 1, s.match[body] - 1), s.match[body], self._params(j, close), returns, s.text(k - 1) == "async", False)

    def _assigned(self, k: int) -> str | None:
        """The name of the variable that what begins at k is assigned to."""
        s = self.s
        if s.text(k - 1) != "=":
            return None
        j = k - 2
        while j >= 0 and s.text(j) not in ("const", "let", "var", ";", "{", "}"):
            j = s.match[j] - 1 if s.text(j) in (")", "]") and j in s.match else j - 1
        return s.text(j + 1) if s.text(j) in ("const", "let", "var") and s.kind(j + 1) == "word" and s.text(j + 2) in ("=", ":") else None

    def _arrow(self, k: int) -> None:
        s = self.s
        j, returns = k - 1, None
        if s.kind(j) == "word" and s.text(j - 1) not in (":", "."):
            first, params = j, [{"name": s.text(j), "type": None, "optional": False, "defaultValue": None, "isRest": False}]
        else:
            while j >= 0 and not (s.text(j) == ")" and (j == k - 1 or s.text(j + 1) == ":")):
                if s.text(j) in (";", "{", "=") and j not in s.match:
                    return
                j = s.match[j] - 1 if s.text(j) in (")", "]", "}") and j in s.match else j - 1
            if j < 0 or j not in s.match:
                return
            first, params = s.match[j], self._params(s.match[j], j)
            returns = s.span(j + 2, k - 1) if j < k - 1 else None
        if s.text(first - 1) == ">":  # type parameters
            depth, j = 0, first - 1
            while j >= 0:
                depth += (s.text(j) == ">") - (s.text(j) == "<")
                if not depth:
                    first = j
                    break
                j -= 1
        is_async = s.text(first - 1) == "async"
        first -= is_async
        name = self._assigned(first)
        if not name:
            return
        if s.text(k + 1) == "{" and k + 1 in s.match:
            body, end = (k + 2, s.match[k + 1] - 1), s.match[k + 1]
        else:
            end = s.expression_end(k + 1)
            body = (k + 1, end)
        self._add(name, first, body, end, params, returns, is_async, True)

    def _class(self, k: int) -> None:
        s = self.s
        j = k + 1
        name = s.text(j) if s.kind(j) == "word" and s.text(j) not in ("extends", "implements") else self._assigned(k)
        extends, implements, mode = None, [], None
        angle = 0
        while j < len(s.tokens) and s.text(j) != "{":
            t = s.text(j)
            angle += (t == "<") - (t == ">")
            if t in ("extends", "implements") and s.kind(j) == "word" and not angle:
                mode = t
            elif mode and not angle and s.kind(j) == "word" and s.text(j - 1) in ("extends", "implements", ","):
                e = j
                while s.text(e + 1) == ".":
                    e += 2
                if mode == "extends" and extends is None:
                    extends = s.span(j, e)
                elif mode == "implements":
                    implements.append(s.span(j, e))
            j += 1
        if not name or j not in s.match:
            return
        first = self._first(k, ("abstract", "declare"))
        end = s.match[j]
        self.classes.append({
            "name": name, "file_path": self.path, "start_line": s.tokens[first].line, "end_line": s.tokens[end].line, "is_exported": self._is_exported(first), "is_abstract": "abstract" in s.span(first, k),
            "extends": extends, "implements": implements, "docstring": s.docs.get(self._first(first, ("export", "default")), s.docs.get(first)),
        })
        self._methods(j + 1, end - 1)

    def _methods(self, k: int, end: int) -> None:
        s = self.s
        while k <= end:
            first = k
            while s.text(k) in _MODIFIERS and s.text(k + 1) not in ("(", "=", ":", ";", "?", "!"):
                k += 1
            k += s.text(k) == "*"
            name_at = k
            j = k + 1 + (s.text(k + 1) == "?")
            if s.text(j) == "<":
                while j <= end and s.text(j) != "(":
                    j += 1
            if s.kind(name_at) == "word" and s.text(j) == "(" and j in s.match and s.text(name_at) not in _NOT_METHODS:
                close = s.match[j]
                returns, body = self._returns(close, ("{", ";"))
                if s.text(body) == "{" and body in s.match:
                    words = {s.text(x) for x in range(first, name_at)}
                    self._add(s.text(name_at), first, (body + 1, s.match[body] - 1), s.match[body], self._params(j, close), returns, "async" in words, False)
                    k = s.match[body] + 1
                    continue
                k = body
            while k <= end and s.text(k) not in (";",):
                nxt = s.match.get(k, k) if s.text(k) in ("(", "[", "{") else k
                if nxt + 1 <= end and s.tokens[nxt + 1].line > s.tokens[nxt].line and s.text(nxt) not in ("=", ",", "|", "&", "=>", ":", "?", "+"):
                    k = nxt
                    break
                k = nxt + 1
            k += 1

    def _interface(self, k: int) -> None:
        s = self.s
        extends, j = [], k + 2
        angle, seen = 0, False
        while j < len(s.tokens) and s.text(j) != "{":
            angle += (s.text(j) == "<") - (s.text(j) == ">")
            if s.text(j) == "extends" and not angle:
                seen = True
            elif seen and not angle and s.kind(j) == "word" and s.text(j - 1) in ("extends", ","):
                extends.append(s.text(j))
            j += 1
        if j in s.match:
            first = self._first(k, ("declare",))
            self.interfaces.append({"name": s.text(k + 1), "file_path": self.path, "start_line": s.tokens[first].line, "end_line": s.tokens[s.match[j]].line, "is_exported": self._is_exported(first), "extends": extends, "docstring": s.docs.get(self._first(first, ("export",)), s.docs.get(first))})

    def _type(self, k: int, kind: str) -> None:
        s = self.s
        first = self._first(k, ("const", "declare"))
        if kind == "enum":
            j = k + 2
            end = s.match.get(j, j)
        else:
            j = k + 2
            while j < len(s.tokens) and s.text(j) != "=":
                j += 1
            end = self._type_end(j + 1)
        self.types.append({"name": s.text(k + 1), "file_path": self.path, "start_line": s.tokens[first].line, "end_line": s.tokens[min(end, len(s.tokens) - 1)].line, "is_exported": self._is_exported(first), "kind": kind, "docstring": s.docs.get(self._first(first, ("export",)), s.docs.get(first))})

    def _type_end(self, k: int) -> int:
        s = self.s
        while k < len(s.tokens) and s.text(k) != ";":
            k = s.match.get(k, k) if s.text(k) in ("(", "[", "{") else k
            if k + 1 < len(s.tokens) and s.tokens[k + 1].line > s.tokens[k].line and s.text(k + 1) not in ("|", "&", "?", ":", "extends", "=>") and s.text(k) not in ("|", "&", "=", "?", ":", "=>", "<", ","):
                return k
            k += 1
        return k

    def _variables(self, k: int) -> None:
        s, kind, j = self.s, self.s.text(k), k + 1
        while j < len(s.tokens):
            if s.kind(j) != "word":  # destructuring makes no rows
                return
            name, at, kind_of = s.text(j), j, None
            j += 1
            j += s.text(j) == "!"
            if s.text(j) == ":":
                start = j = j + 1
                angle = 0
                while j < len(s.tokens) and (angle or s.text(j) not in ("=", ",", ";", "of", "in", ")")):
                    angle += (s.text(j) == "<") - (s.text(j) == ">")
                    j = s.match.get(j, j) + 1 if s.text(j) in ("(", "[", "{") else j + 1
                    if j < len(s.tokens) and not angle and s.tokens[j].line > s.tokens[j - 1].line and s.text(j) not in ("|", "&", "="):
                        break
                kind_of = s.span(start, j - 1)
            self.variables.append({"name": name, "file_path": self.path, "line": s.tokens[at].line, "kind": kind, "is_exported": s.text(k - 1) == "export", "type": kind_of})
            if s.text(j) == "=":
                j = s.expression_end(j + 1) + 1
            if s.text(j) != ",":
                return
            j += 1

    # what bodies hold ---------------------------------------------------------------------------------------------
    def _calls(self, a: int, b: int, f: dict) -> list[dict]:
        s, out = self.s, []
        for k in range(a, b + 1):
            if s.text(k) == "(" and s.kind(k - 1) == "word" and k - 1 >= a and s.text(k - 1) not in _NOT_METHODS and s.text(k - 2) not in ("function", "new", "get", "set"):
                if s.text(k - 1) not in _STOP and not (s.text(s.match.get(k, k) + 1) in ("{", ":") and s.text(k - 2) in ("{", "}", ";", ",")):
                    out.append({"caller": f["name"], "caller_line": f["start_line"], "callee": s.text(k - 1), "line": s.tokens[k - 1].line})
        for k in range(a, b + 1):
            for part in s.tokens[k].parts if k < len(s.tokens) else ():
                for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\(", part):
                    if m[1] not in _STOP and m[1] not in _NOT_METHODS:
                        out.append({"caller": f["name"], "caller_line": f["start_line"], "callee": m[1], "line": s.tokens[k].line})
        return out

    def _jsx(self, a: int, b: int) -> list[tuple[str, int]]:
        """Opening tags in a body: a ``<`` that doesn't follow a value, and a name."""
        s, out = self.s, []
        for k in range(a, b):
            before = s.text(k - 1)
            fresh = before in ("(", "return", "=>", "?", ":", "&&", "||", ">", "}", "{", "=", ",", "[", "/") or self.s.tokens[k].line > self.s.tokens[k - 1].line
            if s.text(k) == "<" and fresh and (s.kind(k + 1) == "word" or s.text(k + 1) == ">"):
                name = s.text(k + 1) if s.kind(k + 1) == "word" else ""
                j = k + 2
                while s.text(j) == "." and s.kind(j + 1) == "word":
                    name, j = f"{name}.{s.text(j + 1)}", j + 2
                out.append((name, s.tokens[k].line))
        return out

    def _component(self, a: int, b: int, f: dict) -> dict | None:
        if not re.match("[A-Z]", f["name"]) or not self._jsx(a, b):
            return None
        first = f["params"][0] if f["params"] else None
        props, kind = [], first["type"] if first else None
        if first and first["name"].startswith("{"):
            for p in re.split(r",\s*", first["name"].strip("{} \n\t")):
                if p and not p.startswith("..."):
                    props.append({"name": re.split(r"[=:\s]", p)[0], "type": None, "required": "=" not in p})
        if kind is None:
            line = self.s.code.split("\n")[f["start_line"] - 1]
            m = re.search(r"(?:FC|FunctionComponent)<([^>]+)>", line)
            kind = m[1] if m else None
        return {"name": f["name"], "file_path": self.path, "start_line": f["start_line"], "end_line": f["end_line"], "is_exported": f["is_exported"], "props": props, "props_type": kind}

    def _renders(self, a: int, b: int, f: dict) -> list[dict]:
        seen: dict[str, int] = {}
        for name, line in self._jsx(a, b):
            if re.match("[A-Z]", name) and name != f["name"]:
                seen.setdefault(name, line)
        return [{"parent": f["name"], "child": n, "line": x} for n, x in seen.items()]
