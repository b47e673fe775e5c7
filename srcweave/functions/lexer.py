"""A small lexer for brace languages (TypeScript, JavaScript, C#) and what is read off its tokens.

It knows comments, strings, templates, regular expressions, words, numbers and signs, and matches brackets. That is
enough for declarations, calls and control flow; it doesn't build a full syntax tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+|\n)
    |(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<number>\d[\w.]*)
    |(?P<word>[A-Za-z_$@#][\w$]*)
    |(?P<sign>=>|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.|\.\.\.|\+\+|--|\+=|-=|\*=|/=|::|.)""",
    re.VERBOSE | re.DOTALL,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int
    line: int
    column: int
    parts: list[str] = field(default_factory=list)  # of a template: the expressions in it


def _template(code: str, at: int) -> tuple[int, list[str]]:
    """(end of the template that starts at ``at``, its expressions)."""
    k, parts = at + 1, []
    while k < len(code) and code[k] != "`":
        if code[k] == "\\":
            k += 2
        elif code.startswith("${", k):
            depth, start = 1, k + 2
            k += 2
            while k < len(code) and depth:
                if code[k] == "`":
                    k = _template(code, k)[0]
                    continue
                depth += (code[k] == "{") - (code[k] == "}")
                k += 1
            parts.append(code[start : k - 1])
        else:
            k += 1
    return min(k + 1, len(code)), parts


class Source:
    """Tokens of a file without blanks and comments, each bracket's partner, and the doc comments."""

    def __init__(self, code: str, verbatim: bool = False):
        self.code = code
        self.tokens: list[Token] = []
        self.docs: dict[int, str] = {}  # by the number of the token that follows
        line, line_at, at, doc = 1, 0, 0, None
        while at < len(code):
            c = code[at]
            parts: list[str] = []
            if c == "`" and not verbatim:
                end, parts = _template(code, at)
                kind = "template"
            elif verbatim and (m := re.compile(r'[$@]{1,2}"').match(code, at)):
                end = m.end()
                raw = "@" in m[0]
                while end < len(code) and (code[end] != '"' or (raw and code.startswith('""', end))):
                    end += 2 if (raw and code[end] == '"') or (not raw and code[end] == "\\") else 1
                end, kind = min(end + 1, len(code)), "string"
            elif c == "/" and not verbatim and self._regex_here() and (m := re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(code, at)):
                end, kind = m.end(), "regex"
            else:
                m = _TOKEN.match(code, at)
                end, kind = m.end(), m.lastgroup
            text = code[at:end]
            if kind == "comment":
                doc = text if text.startswith("/**") else None if text.startswith("/*") else doc
            elif kind != "space":
                if doc is not None:
                    self.docs[len(self.tokens)] = doc
                doc = None
                self.tokens.append(Token(kind, text, at, end, line, at - line_at, parts))
            n = text.count("\n")
            if n:
                line, line_at = line + n, at + text.rindex("\n") + 1
            at = end
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(k)
            elif t.kind == "sign" and t.text in _CLOSE:
                while stack and _OPEN[self.tokens[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    o = stack.pop()
                    self.match[o], self.match[k] = k, o

    def _regex_here(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.text in _BEFORE_REGEX if t.kind == "word" else t.kind == "sign" and t.text not in (")", "]", "}")

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def span(self, a: int, b: int) -> str:
        """The code of tokens a .. b."""
        return self.code[self.tokens[a].at : self.tokens[b].end] if a <= b < len(self.tokens) else ""

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between the commas of a .. b, brackets left whole."""
        out, start, k, angle = [], a, a, 0
        while k <= b:
            if self.text(k) in _OPEN and k in self.match:
                k = self.match[k]
            elif self.kind(k) == "sign" and self.text(k) == "<":
                angle += 1
            elif self.kind(k) == "sign" and self.text(k) == ">":
                angle = max(0, angle - 1)
            elif self.text(k) == "," and not angle:
                if start < k:
                    out.append((start, k - 1))
                start = k + 1
            k += 1
        if start <= b:
            out.append((start, b))
        return out

    def expression_end(self, k: int) -> int:
        """The last token of the expression that begins at k."""
        last = k
        while k < len(self.tokens):
            t = self.text(k)
            if t in _OPEN and k in self.match:
                k = self.match[k]
            elif t in _CLOSE or t in (",", ";"):
                break
            elif k > last and self.tokens[k].line > self.tokens[k - 1].line and self.kind(k) == "word" and self.kind(k - 1) != "sign":
                break
            last = k
            k += 1
        return last


#: Words of constructs that decide, that break the flow, and that nest.
_LOOPS = {"for", "foreach", "while"}


def complexity(s: Source, a: int, b: int) -> tuple[int, int, int]:
    """(cyclomatic, cognitive, nesting) of the function body in tokens a .. b.

    Each if, else, loop, case, catch and conditional decides; these, break and continue cost one and the depth they
    stand at; logical signs cost one in both. If, loops, switch, try, catch and inner functions nest. An else hangs
    in its if, a catch in its try, so they stand one deeper.
    """
    cyclomatic, cognitive, deepest = 1, 0, 0
    if a > b:
        return cyclomatic, cognitive, deepest

    def statement(k: int, depth: int) -> int:
        """Walk one statement at k; returns the next token."""
        t = s.text(k)
        if t == "{" and k in s.match:
            return block(k + 1, s.match[k] - 1, depth, s.match[k] + 1)
        if t == "default" and s.text(k + 1) == ":":
            return k + 2
        if s.kind(k) == "word" and s.text(k - 1) != "." and s.text(k + 1) != ":":
            if t in ("if",) or t in _LOOPS:
                decide(depth)
                inner = nest(depth)
                k += 2 if s.text(k + 1) == "await" else 1
                if s.text(k) == "(" and k in s.match:
                    expression(k + 1, s.match[k] - 1, inner)
                    k = s.match[k] + 1
                k = statement(k, inner)
                while t == "if" and s.text(k) == "else" and k <= b:
                    decide(inner)
                    k = statement(k + 1, inner)
                return k
            if t == "do":
                decide(depth)
                k = statement(k + 1, nest(depth))
                if s.text(k) == "while" and s.text(k + 1) == "(":
                    expression(k + 2, s.match.get(k + 1, k + 2) - 1, depth + 1)
                    k = s.match.get(k + 1, k + 1) + 1
                return k
            if t == "switch" and s.text(k + 1) == "(":
                inner = nest(depth)
                o = s.match.get(k + 1, k + 1)
                expression(k + 2, o - 1, inner)
                return block(o + 2, s.match.get(o + 1, o + 1) - 1, inner, s.match.get(o + 1, o + 1) + 1)
            if t == "try":
                inner = nest(depth)
                k = statement(k + 1, inner)
                while s.text(k) in ("catch", "finally"):
                    word = s.text(k)
                    deeper = inner
                    if word == "catch":
                        decide(inner)
                        deeper = nest(inner)
                    k += 1
                    if s.text(k) == "(" and k in s.match:
                        k = s.match[k] + 1
                    k = statement(k, deeper)
                return k
            if t == "case":
                decide(depth)
                j = k + 1
                while j <= b and s.text(j) != ":":
                    j = s.match.get(j, j) + 1 if s.text(j) in _OPEN else j + 1
                expression(k + 1, j - 1, depth)
                return j + 1
            if t in ("break", "continue"):
                cost(depth)
                return k + 1
            if t in ("return", "throw", "else"):
                return k + 1
        end = min(s.expression_end(k), b)
        expression(k, end, depth)
        return end + 1

    def block(k: int, end: int, depth: int, after: int) -> int:
        while k <= end:
            k = max(statement(k, depth), k + 1)
        return after

    def expression(k: int, end: int, depth: int) -> None:
        nonlocal cyclomatic, cognitive
        while k <= end:
            t, kind = s.text(k), s.kind(k)
            if kind == "sign" and t in ("&&", "||", "??"):
                cyclomatic, cognitive = cyclomatic + 1, cognitive + 1
            elif kind == "sign" and t == "?" and s.text(k + 1) not in (":", ")", ",", "=", ";", "]") and s.text(k - 1) not in ("(", ","):
                decide(depth)
            elif kind == "template":
                for part in s.tokens[k].parts:
                    c, g, n = complexity(Source(part), 0, len(Source(part).tokens) - 1)
                    cyclomatic, cognitive = cyclomatic + c - 1, cognitive + g
            elif kind == "sign" and t == "=>":
                inner = nest(depth)
                if s.text(k + 1) == "{" and k + 1 in s.match:
                    block(k + 2, s.match[k + 1] - 1, inner, 0)
                    k = s.match[k + 1]
                else:
                    e = min(s.expression_end(k + 1), end)
                    expression(k + 1, e, inner)
                    k = e
            elif kind == "word" and t == "function" and k < end:
                o = k + 1
                while o <= end and s.text(o) != "(":
                    o += 1
                body = s.match.get(o, o) + 1
                if s.text(body) == "{" and body in s.match:
                    block(body + 1, s.match[body] - 1, nest(depth), 0)
                    k = s.match[body]
            elif t == "{" and k in s.match and s.text(k - 1) == ")":
                block(k + 1, s.match[k] - 1, depth, 0)
                k = s.match[k]
            k += 1

    def decide(depth: int) -> None:
        nonlocal cyclomatic
        cyclomatic += 1
        cost(depth)

    def cost(depth: int) -> None:
        nonlocal cognitive
        cognitive += 1 + depth

    def nest(depth: int) -> int:
        nonlocal deepest
        deepest = max(deepest, depth + 1)
        return depth + 1

    block(a, b, 0, b + 1)
    return cyclomatic, cognitive, deepest
