"""Entities of Python files, by the standard library's parser."""

from __future__ import annotations

import ast

from .stoplists import PYTHON_BUILTINS

_STOP = frozenset(PYTHON_BUILTINS)
_DECIDES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.Match, ast.Lambda, ast.FunctionDef, ast.AsyncFunctionDef)


def complexity(node: ast.AST) -> tuple[int, int, int]:
    """(cyclomatic, cognitive, nesting) with the same weights as for the brace languages."""
    cyclomatic, cognitive, deepest = 1, 0, 0

    def walk(n: ast.AST, depth: int) -> None:
        nonlocal cyclomatic, cognitive, deepest
        if isinstance(n, _DECIDES):
            cyclomatic += 1
            cognitive += 1 + depth
        elif isinstance(n, (ast.Break, ast.Continue)):
            cognitive += 1 + depth
        elif isinstance(n, ast.BoolOp):
            cyclomatic += len(n.values) - 1
            cognitive += len(n.values) - 1
        inner = depth + isinstance(n, _NESTS)
        deepest = max(deepest, inner)
        if isinstance(n, (ast.If, ast.For, ast.While)) and n.orelse and not (isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)):
            cyclomatic += 1  # an else
            cognitive += 1 + inner
        for child in ast.iter_child_nodes(n):
            walk(child, inner)

    for child in node.body:
        walk(child, 0)
    return cyclomatic, cognitive, deepest


class Module:
    def __init__(self, path: str, code: str):
        self.path = path
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.variables: list[dict] = []
        self.imports: list[dict] = []
        self.calls: list[dict] = []
        self.interfaces, self.types, self.components, self.renders = [], [], [], []
        tree = ast.parse(code)
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._function(n)
            elif isinstance(n, ast.ClassDef):
                self._class(n)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    self._import(n, a.name, [], a.asname or a.name)
            elif isinstance(n, ast.ImportFrom):
                names = [{"name": a.name, "alias": a.asname} for a in n.names]
                self._import(n, "." * n.level + (n.module or ""), names, None)
        for n in tree.body:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
            for t in targets:
                if isinstance(t, ast.Name):
                    kind = "const" if t.id == t.id.upper() else "let"
                    hint = ast.unparse(n.annotation) if isinstance(n, ast.AnnAssign) else None
                    self.variables.append({"name": t.id, "file_path": path, "line": n.lineno, "kind": kind, "is_exported": not t.id.startswith("_"), "type": hint})

    def _import(self, n, module, names, default) -> None:
        star = any(x["name"] == "*" for x in names)
        self.imports.append({
            "file_path": self.path, "source": module, "line": n.lineno, "is_default": False, "is_namespace": star or not names, "specifiers": [x for x in names if x["name"] != "*"],
            "namespace_alias": default, "default_alias": None, "resolved_path": None,
        })

    def _function(self, n) -> None:
        params = []
        args = [*n.args.posonlyargs, *n.args.args]
        defaults = [None] * (len(args) - len(n.args.defaults)) + list(n.args.defaults)
        rows = [(a, d, False) for a, d in zip(args, defaults, strict=True)]
        rows += [(n.args.vararg, None, True)] if n.args.vararg else []
        rows += [(a, d, False) for a, d in zip(n.args.kwonlyargs, n.args.kw_defaults, strict=True)]
        rows += [(n.args.kwarg, None, True)] if n.args.kwarg else []
        for a, d, rest in rows:
            if a.arg not in ("self", "cls"):
                params.append({"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None, "optional": d is not None, "defaultValue": ast.unparse(d) if d is not None else None, "isRest": rest})
        cyclomatic, cognitive, nesting = complexity(n)
        self.functions.append({
            "name": n.name, "file_path": self.path, "start_line": n.lineno, "end_line": n.end_lineno, "is_exported": not n.name.startswith("_"), "is_async": isinstance(n, ast.AsyncFunctionDef),
            "is_arrow": False, "params": params, "return_type": ast.unparse(n.returns) if n.returns else None, "docstring": ast.get_docstring(n), "complexity": cyclomatic,
            "cognitive_complexity": cognitive, "nesting_depth": nesting,
        })
        for c in ast.walk(n):
            if isinstance(c, ast.Call):
                name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
                if name and name not in _STOP:
                    self.calls.append({"file_path": self.path, "caller": n.name, "caller_line": n.lineno, "callee": name, "line": c.lineno})

    def _class(self, n) -> None:
        bases = [ast.unparse(b) for b in n.bases]
        self.classes.append({
            "name": n.name, "file_path": self.path, "start_line": n.lineno, "end_line": n.end_lineno, "is_exported": not n.name.startswith("_"), "is_abstract": any("ABC" in b for b in bases),
            "extends": bases[0] if bases else None, "implements": [], "docstring": ast.get_docstring(n),
        })
