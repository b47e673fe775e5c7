"""Names that call extraction leaves out."""

from __future__ import annotations

#: JavaScript built-ins and common helpers.
JS_BUILTINS = (
    "log", "warn", "error", "info", "debug", "trace",
    "require", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "parseInt", "parseFloat", "isNaN", "isFinite",
    "map", "filter", "reduce", "forEach", "find", "some", "every",
    "push", "pop", "shift", "unshift", "slice", "splice", "concat",
    "split", "join", "trim", "replace", "match", "includes", "startsWith", "endsWith",
    "keys", "values", "entries", "assign", "freeze",
    "then", "catch", "finally", "resolve", "reject", "all", "race",
)
#: Python built-ins, test and logging helpers.
PYTHON_BUILTINS = (
    "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple",
    "type", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr",
    "open", "input", "format", "repr", "abs", "min", "max", "sum", "sorted", "reversed",
    "enumerate", "zip", "map", "filter", "any", "all", "next", "iter", "id", "hash",
    "dir", "vars", "globals", "locals", "callable", "super", "property", "classmethod",
    "staticmethod", "object", "bool", "bytes", "bytearray", "memoryview", "complex",
    "divmod", "pow", "round", "chr", "ord", "bin", "oct", "hex", "slice", "frozenset",
    "compile", "exec", "eval", "breakpoint", "help", "exit", "quit",
    "assert", "assertEqual", "assertTrue", "assertFalse", "assertRaises", "assertIn",
    "assertIsNone", "assertIsNotNone", "assertIs", "assertIsNot", "fail",
    "info", "debug", "warning", "error", "critical", "exception",
)
#: C# framework names.
CSHARP_BUILTINS = (
    "Console", "WriteLine", "ReadLine", "Write", "Read",
    "ToString", "Equals", "GetHashCode", "GetType",
    "Add", "Remove", "Clear", "Contains", "Count",
    "ToList", "ToArray", "ToDictionary", "First", "Last",
    "Where", "Select", "OrderBy", "GroupBy", "Any", "All",
    "FirstOrDefault", "LastOrDefault", "SingleOrDefault",
    "ConfigureAwait", "Wait", "Result",
    "Assert", "AreEqual", "IsTrue", "IsFalse", "IsNull", "IsNotNull",
    "ThrowsException", "Fail",
    "LogInformation", "LogWarning", "LogError", "LogDebug", "Log",
)
#: Names that symbol resolution takes as built in.
GLOBALS = (
    "console", "Math", "JSON", "Object", "Array", "String", "Number",
    "Boolean", "Date", "Promise", "Map", "Set", "RegExp", "Error",
    "parseInt", "parseFloat", "setTimeout", "setInterval", "clearTimeout",
    "fetch", "require", "module", "exports", "__dirname", "__filename",
)
