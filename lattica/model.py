"""Row schemas and identities of code entities."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: The kinds of entities, and the class of each in the vocabulary.
KINDS = {
    "module": "Module",
    "function": "Function",
    "method": "Method",
    "class": "Class",
    "interface": "Interface",
    "variable": "Variable",
    "property": "Property",
    "parameter": "Parameter",
    "import": "Import",
    "export": "Export",
    "call": "CallExpression",
}
#: Kinds whose entities are also of a wider one.
WIDER = {"Method": "Function", "Property": "Variable", "Parameter": "Variable"}
BASE = "http://codebase.local/"

PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("default_value", T.StringType()), T.StructField("is_rest", T.BooleanType()), T.StructField("is_optional", T.BooleanType()), T.StructField("type_name", T.StringType())])

_TEXT = "uri kind name file_path docstring body_hash scope parent_uri extends_class type_name init declared module_path import_type alias export_type source_module caller_uri callee_name module_type"
_NUMBERS = "line_number column_number end_line end_column ordinal"
_FLAGS = "is_async is_generator is_arrow_function is_exported is_default_export is_static is_private is_protected is_readonly is_constructor is_getter is_setter is_abstract is_type_only is_re_export is_method_call"
_LISTS = "calls accesses implements type_parameters imported_symbols arguments comments"

#: One wide row for an entity of any kind; what a kind lacks is null.
ENTITY = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT.split()]
    + [T.StructField(c, T.IntegerType()) for c in _NUMBERS.split()]
    + [T.StructField(c, T.BooleanType()) for c in _FLAGS.split()]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS.split()]
    + [T.StructField("parameters", T.ArrayType(PARAMETER))]
)


def entity_uri(file_path: str, kind: str, name: str, line: int) -> str:
    if kind == "module":
        return f"{BASE}{file_path}#module"
    return f"{BASE}{file_path}#{kind}_{re.sub('[^A-Za-z0-9_]+', '_', name)}_{line}"


def entity_class(kind: str) -> str:
    """The class of a kind; an unknown kind is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown entity kind {kind!r}")
    return KINDS[kind]


def range_text(line: int, column: int, end_line: int | None = None, end_column: int | None = None) -> str:
    """``l:c``, or ``l:c-el:ec`` where both ends are known."""
    return f"{line}:{column}-{end_line}:{end_column}" if end_line and end_column else f"{line}:{column}"
