"""The property graph's labels, typed schemas and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Node labels.
NODE_LABELS = (
    "File", "Class", "Interface", "Function", "Variable", "Import", "Type", "Component", "Commit",
    "MarkdownDocument", "Section", "CodeBlock", "Link",
)
#: Edge types that statistics report.
EDGE_LABELS = (
    "CONTAINS", "IMPORTS", "IMPORTS_SYMBOL", "CALLS", "EXTENDS", "IMPLEMENTS", "USES_TYPE", "RETURNS", "HAS_PARAM",
    "HAS_METHOD", "HAS_PROPERTY", "RENDERS", "USES_HOOK", "INTRODUCED_IN", "MODIFIED_IN", "DELETED_IN", "READS",
    "WRITES", "FLOWS_TO", "EXPORTS", "INSTANTIATES", "HAS_SECTION", "PARENT_SECTION", "CONTAINS_CODE", "LINKS_TO",
)

PARAMS = "array<struct<name:string,type:string,optional:boolean,defaultValue:string,isRest:boolean>>"
PROPS = "array<struct<name:string,type:string,required:boolean>>"
SPECIFIERS = "array<struct<name:string,alias:string>>"

SCHEMAS = {
    "File": "path string, name string, extension string, loc int, last_modified string, hash string",
    "Function": f"name string, file_path string, start_line int, end_line int, is_exported boolean, is_async boolean, is_arrow boolean, params {PARAMS}, return_type string, docstring string, complexity int, cognitive_complexity int, nesting_depth int",
    "Class": "name string, file_path string, start_line int, end_line int, is_exported boolean, is_abstract boolean, extends string, implements array<string>, docstring string",
    "Interface": "name string, file_path string, start_line int, end_line int, is_exported boolean, extends array<string>, docstring string",
    "Variable": "name string, file_path string, line int, kind string, is_exported boolean, type string",
    "Type": "name string, file_path string, start_line int, end_line int, is_exported boolean, kind string, docstring string",
    "Component": f"name string, file_path string, start_line int, end_line int, is_exported boolean, props {PROPS}, props_type string",
    "Import": f"file_path string, source string, line int, is_default boolean, is_namespace boolean, specifiers {SPECIFIERS}, namespace_alias string, default_alias string, resolved_path string",
    "Commit": "hash string, message string, author string, email string, date string",
    "Project": "id string, name string, root_path string, created_at string, last_parsed string, file_count int",
    "Metadata": "key string, value string",
}
EDGE_SCHEMA = "src string, dst string, label string, line int, count bigint"

#: Key columns by which an upsert finds a node.
KEYS = {
    "File": ["path"], "Function": ["name", "file_path", "start_line"], "Class": ["name", "file_path", "start_line"],
    "Interface": ["name", "file_path", "start_line"], "Variable": ["name", "file_path", "line"], "Type": ["name", "file_path", "start_line"],
    "Component": ["name", "file_path", "start_line"], "Commit": ["hash"], "Project": ["id"], "Metadata": ["key"],
}


def node_id(label: Column | str, file_path: Column, name: Column | None = None, line: Column | None = None) -> Column:
    """``File:<path>``, or ``<Label>:<file>:<name>:<line>`` with line 0 where there is none."""
    label = F.lit(label) if isinstance(label, str) else label
    if name is None:
        return F.concat(label, F.lit(":"), file_path)
    return F.concat(label, F.lit(":"), file_path, F.lit(":"), name, F.lit(":"), F.coalesce(line if line is not None else F.lit(0), F.lit(0)).cast("string"))


def edge_id(label: Column, src: Column, dst: Column) -> Column:
    return F.concat(label, F.lit(":"), src, F.lit("->"), dst)


def extractor_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    """The extractors' own id, with anything but letters, digits, ``:_-`` as an underscore."""
    return F.regexp_replace(F.concat_ws(":", path, kind, name, line.cast("string")), "[^a-zA-Z0-9:_-]", "_")


def label_of(labels: Column) -> Column:
    """A node's label: the first known of its labels; else Class if external; else File."""
    known = F.filter(labels, lambda x: x.isin(*NODE_LABELS))
    return F.when(F.size(known) > 0, known[0]).when(F.array_contains(labels, "External"), F.lit("Class")).otherwise(F.lit("File"))
