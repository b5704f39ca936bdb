"""RDF terms as canonical strings, and column expressions over them.

A term is ``<iri>``, ``_:label``, ``"text"``, ``"text"@lang`` or
``"text"^^<datatype>``.  The text stands unescaped: the suffix never holds a
quote, so the last quote ends it.  A simple literal and an ``xsd:string`` are
one term, so equality of terms is equality of strings and joins are plain
equi-joins.
"""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
#: The namespace of the code vocabulary; ``LATTICA_VOCABULARY`` names another, such as that of an existing graph.
CODE = os.environ.get("LATTICA_VOCABULARY", "http://code.local/vocabulary#")
KG = "http://kg.local/"

RDF_TYPE = f"<{RDF}type>"
#: Numeric datatypes of XML Schema.
NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")


def iri(value: str) -> str:
    return f"<{value}>"


def literal(value: object, datatype: str | None = None, lang: str | None = None) -> str:
    """The term of a Python value."""
    if lang:
        return f'"{value}"@{lang.lower()}'
    if datatype is None:
        if isinstance(value, bool):
            value, datatype = str(value).lower(), XSD + "boolean"
        elif isinstance(value, int):
            datatype = XSD + "integer"
        elif isinstance(value, float):
            datatype = XSD + "double"
    if datatype in (None, XSD + "string"):
        return f'"{value}"'
    return f'"{value}"^^<{datatype}>'


def parts(term: str) -> tuple[str, str, str, str]:
    """(lexical form, kind, datatype, lang) of a term; kind is iri, bnode or literal."""
    if term.startswith("<"):
        return term[1:-1], "iri", "", ""
    if term.startswith("_:"):
        return term[2:], "bnode", "", ""
    end = term.rindex('"')
    text, suffix = term[1:end], term[end + 1 :]
    if suffix.startswith("@"):
        return text, "literal", RDF + "langString", suffix[1:]
    return text, "literal", suffix[3:-1] if suffix else XSD + "string", ""


def lexical(term: Column) -> Column:
    """The lexical form of a term: an IRI without brackets, a literal's text."""
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).when(term.startswith("_:"), F.substring(term, F.lit(3), F.length(term))).otherwise(
        F.substring(term, F.lit(2), F.length(term) - F.instr(F.reverse(term), '"') - 1)
    )


def suffix(term: Column) -> Column:
    """What follows a literal's last quote; empty for other terms."""
    return F.when(term.startswith('"'), F.substring_index(term, '"', -1)).otherwise(F.lit(""))


def datatype(term: Column) -> Column:
    """The datatype IRI of a literal, without brackets; null for other terms."""
    end = suffix(term)
    return F.when(~term.startswith('"'), F.lit(None)).when(end == "", F.lit(XSD + "string")).when(end.startswith("@"), F.lit(RDF + "langString")).otherwise(F.substring(end, F.lit(4), F.length(end) - 4))


def lang(term: Column) -> Column:
    """The language of a literal, empty without one; null for other terms."""
    end = suffix(term)
    return F.when(~term.startswith('"'), F.lit(None)).when(end.startswith("@"), F.substring(end, F.lit(2), F.length(end))).otherwise(F.lit(""))


def numeric(term: Column) -> Column:
    """A numeric literal's value as a double; null for other terms."""
    return F.when(suffix(term).isin([f"^^<{XSD}{kind}>" for kind in NUMERIC]), lexical(term).try_cast("double"))


def boolean(term: Column) -> Column:
    """The effective boolean value of a term; null where it has none."""
    text, end = lexical(term), suffix(term)
    return (
        F.when(end == f"^^<{XSD}boolean>", text.isin("true", "1"))
        .when(numeric(term).isNotNull(), numeric(term) != 0)
        .when(term.startswith('"') & (end == ""), F.length(text) > 0)
    )


def text_term(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def typed_term(value: Column, kind: str) -> Column:
    """The term of a plain column; ``kind`` is the local name of its XML Schema datatype."""
    text = value.cast("string")
    return text_term(text) if kind == "string" else F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{kind}>'))


def iri_term(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def sort_key(term: Column) -> Column:
    """Order of terms: unbound, blank nodes, IRIs, literals (numbers by value, then by text)."""
    rank = F.when(term.isNull(), 0).when(term.startswith("_:"), 1).when(term.startswith("<"), 2).otherwise(3)
    return F.struct(rank.alias("rank"), numeric(term).alias("number"), term.alias("text"))
