"""Security, payment and data-flow findings of TypeScript and JavaScript files."""

from __future__ import annotations

import re

from . import rules as R
from .lexer import Source

_CHAIN = {".", "?.", "!"}
_SECRETS = tuple(re.compile(p) for p in R.SECRETS)
_KEYS = tuple(re.compile(p) for p in R.PAYMENT_KEYS)
#: Payment calls that should carry an idempotency key.
_IDEMPOTENT = ("charges.create", "paymentIntents.create", "paymentIntents.confirm", "refunds.create", "transfers.create", "payouts.create", "subscriptions.create")


class Call:
    """A call: its callee's text and last segment, its arguments' token ranges, and where it begins."""

    def __init__(self, s: Source, k: int):
        self.s, self.open, self.close = s, k, s.match[k]
        a = k - 1
        while a > 0 and s.text(a - 1) in _CHAIN:
            a -= 2
            while s.text(a) in (")", "]") and a in s.match:
                a = s.match[a] - 1
        self.first = max(a, 0)
        self.callee = s.span(self.first, k - 1)
        self.method = re.split(r"\?\.|\.", self.callee)[-1]
        self.args = s.split(k + 1, self.close - 1)
        self.text = s.span(self.first, self.close)

    def arguments(self) -> str:
        return self.s.span(self.open, self.close)


def calls(s: Source) -> list[Call]:
    return [Call(s, k) for k in range(1, len(s.tokens)) if s.text(k) == "(" and s.kind(k) == "sign" and k in s.match and s.kind(k - 1) == "word" and s.text(k - 1) not in ("if", "for", "while", "switch", "catch", "function", "return")]


def shape(s: Source, a: int, b: int) -> str:
    """What an argument is: template, dynamic_template, string, concat, identifier, call or other."""
    if a == b:
        t = s.tokens[a]
        if t.kind == "template":
            return "dynamic_template" if t.parts else "template"
        return {"word": "identifier", "string": "string"}.get(t.kind, "other")
    k, plus, quoted, top = a, False, False, True
    while k <= b:
        plus |= s.text(k) == "+"
        quoted |= s.kind(k) in ("string", "template")
        if s.text(k) in ("(", "[", "{") and k in s.match:
            top = top and (s.match[k] < b or s.text(k) == "(")
            k = s.match[k]
        k += 1
    if plus and quoted:
        return "concat"
    return "call" if s.text(b) == ")" and s.kind(s.match.get(b, a) - 1) == "word" and not plus else "other"


def _finding(kind: str, severity: str, file: str, s: Source, k: int, code: str, description: str, fix: str, n: int = 100) -> dict:
    t = s.tokens[k]
    return {"type": kind, "severity": severity, "file": file, "line": t.line, "column": t.column, "code": code[:n] + ("..." if n == 50 and len(code) > n else ""), "description": description, "fix": fix}


def _assignments(s: Source) -> list[tuple[int, int, int]]:
    """(first token of the left side, of the right side, last of the right side) of assignments and declarators."""
    out = []
    for k in range(1, len(s.tokens) - 1):
        if s.text(k) == "=" and s.kind(k) == "sign":
            a = k - 1
            if s.kind(a) == "word" or s.text(a) == "]":
                while a > 0:
                    if s.text(a) == "]" and a in s.match:
                        a = s.match[a] - 1
                    elif s.text(a - 1) in _CHAIN:
                        a -= 2
                    else:
                        break
                if s.text(a - 1) == ":" and s.kind(a) == "word":  # a declared type stands between
                    j = a - 1
                    while j > 0 and s.text(j) not in ("const", "let", "var", ";", "{", "}", "(", ","):
                        j -= 1
                    a = j + 1 if s.text(j) in ("const", "let", "var") else a
                out.append((a, k + 1, s.expression_end(k + 1)))
    return out


def findings(path: str, code: str, payments: bool = True) -> list[dict]:
    """Rows (type, severity, file, line, column, code, description, fix)."""
    s, out = Source(code), []
    every = calls(s)
    for c in every:
        shapes = [shape(s, a, b) for a, b in c.args]
        first = shapes[0] if shapes else ""
        add = lambda kind, severity, text, fix, c=c: out.append(_finding(kind, severity, path, s, c.first, c.text, text, fix))
        if c.method in R.SQL_METHODS:
            for x in shapes:
                if x in ("dynamic_template", "concat"):
                    add("sql_injection", "critical", "Query text is put together from values", "Pass values as query parameters")
        if c.callee in R.HTML_METHODS:
            add("xss", "high", "Markup is written straight into the document", "Build nodes, or set text content")
        if c.method in R.COMMAND_METHODS and (first in ("template", "dynamic_template", "concat") or (first == "identifier" and any(p in c.text for p, _ in R.TAINT_SOURCES))):
            add("command_injection", "critical", "A command is put together from values", "Pass arguments as a list, without a shell")
        if c.method in R.PATH_METHODS and first in ("template", "dynamic_template", "concat", "identifier", "call"):
            add("path_traversal", "high", "A file is opened by a path that varies", "Resolve the path and check that it stays in its folder")
        if c.callee in R.EVAL_FUNCTIONS:
            add("eval", "high", "Text is run as code", "Avoid running text as code")
        if c.method in R.TIMER_FUNCTIONS and first in ("string", "template", "dynamic_template"):
            add("eval", "high", "A timer runs text as code", "Give the timer a function")
        if payments:
            _payment(c, add)
    for a, b, e in _assignments(s):
        left = s.span(a, b - 2)
        whole = s.span(a, e)
        if re.split(r"\?\.|\.", left)[-1] in R.HTML_PROPERTIES:
            out.append(_finding("xss", "high", path, s, a, whole, "Markup is assigned from a value", "Set text content, or clean the markup first"))
        if any(p.search(whole) for p in _SECRETS):
            out.append(_finding("hardcoded_secret", "critical", path, s, a, whole, "A secret stands in an assignment", "Read secrets from the environment or a secret store", 50))
    for k, t in enumerate(s.tokens):
        if t.text == R.HTML_ATTRIBUTE and t.kind == "word":
            out.append(_finding("xss", "high", path, s, k, s.code[t.at : t.at + 100], "Markup is set from a value", "Clean the markup, or render elements"))
        if t.kind in ("string", "template"):
            if any(p.search(t.text) for p in _SECRETS):
                out.append(_finding("hardcoded_secret", "critical", path, s, k, t.text, "A secret stands in the code", "Read secrets from the environment or a secret store", 50))
            if payments and any(p.search(t.text) for p in _KEYS):
                out.append(_finding("hardcoded_payment_key", "critical", path, s, k, t.text, "A payment key stands in the code", "Read keys from the environment or a secret store", 30))
    return sorted(out, key=lambda f: (f["line"], f["column"], f["type"]))


def _payment(c: Call, add) -> None:
    args = c.arguments()
    pays = any(m in c.callee for m in R.STRIPE_METHODS) or c.method in R.ADYEN_METHODS
    if pays and any(x in args for x in R.AMOUNT_SOURCES):
        add("unvalidated_payment_amount", "critical", "The amount comes from the request", "Compute or check the amount on the server")
    if c.callee in R.LOG_FUNCTIONS and any(x.lower() in args.lower() for x in R.CARD_FIELDS):
        add("pci_data_logging", "critical", "Card data is logged", "Leave card data out of logs, or mask it")
    if any(m in c.callee for m in _IDEMPOTENT) and not any(x in args for x in R.IDEMPOTENCY_NAMES):
        add("missing_idempotency_key", "high", "A retry may charge twice", "Pass an idempotency key")


def card_words_only(finding: dict) -> bool:
    """Stricter variant of the logging rule: a field name as a whole word, so that ``company`` isn't ``pan``."""
    return bool(re.search(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(R.CARD_FIELDS) + r")(?![A-Za-z0-9_])", finding["code"]))


def deduplicated(rows: list[dict]) -> list[dict]:
    """One row for each (file, line, type)."""
    seen: dict[tuple, dict] = {}
    for r in rows:
        seen.setdefault((r["file"], r["line"], r["type"]), r)
    return list(seen.values())


def flow_points(path: str, code: str) -> tuple[list[dict], list[dict]]:
    """(sources (file, category, pattern, variable, line, column), sinks (file, category, severity, pattern, argument, line, column))."""
    s, sources, sinks = Source(code), [], []
    named: set[int] = set()

    def source(text: str, variable: str, k: int) -> None:
        for pattern, category in R.TAINT_SOURCES:
            if pattern in text:
                t = s.tokens[k]
                sources.append({"file": path, "category": category, "pattern": pattern, "variable": variable, "line": t.line, "column": t.column})
                return

    for a, b, e in _assignments(s):
        right = s.span(b, e)
        if s.kind(b) == "word" and shape(s, b, e) in ("identifier", "call", "other") and not re.search(r"[-+*]\s", right):
            n = len(sources)
            source(right, s.text(a) if s.text(a + 1) in (":", "=") else s.span(a, b - 2), b)
            if len(sources) > n:
                named.update(range(b, e + 1))
        for patterns, category, severity in R.TAINT_SINKS:
            if category == "xss" and re.split(r"\?\.|\.", s.span(a, b - 2))[-1] in patterns:
                t = s.tokens[a]
                sinks.append({"file": path, "category": category, "severity": severity, "pattern": s.span(a, b - 2), "argument": right, "line": t.line, "column": t.column})
    k = 0
    while k < len(s.tokens):
        if s.kind(k) == "word" and s.text(k - 1) not in _CHAIN:
            e = k
            while s.text(e + 1) in _CHAIN and s.kind(e + 2) == "word":
                e += 2
            if e > k and not named.intersection((k, e)):
                source(s.span(k, e), s.span(k, e), k)
            k = e
        k += 1
    for c in calls(s):
        for patterns, category, severity in R.TAINT_SINKS:
            if (category != "xss" and c.method in patterns) or (category == "xss" and c.callee in patterns):
                t = s.tokens[c.first]
                sinks.append({"file": path, "category": category, "severity": severity, "pattern": c.callee, "argument": c.arguments(), "line": t.line, "column": t.column})
                break
    return sources, sinks
