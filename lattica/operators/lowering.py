"""Entities to triples, and to a property graph."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.functions.staging import stage
from lattica.functions.terms import CODE, RDF_TYPE
from lattica.model import BASE, KINDS, WIDER
from lattica.operators.extract import module_imports, resolved_calls


def code(local: str) -> str:
    return f"<{CODE}{local}>"


def first_by_uri(entities: DataFrame) -> DataFrame:
    """One entity for each URI: the first by file and place."""
    rank = F.row_number().over(Window.partitionBy("uri").orderBy("file_path", "ordinal"))
    return entities.withColumn(" rank", rank).where(F.col(" rank") == 1).drop(" rank")


def _text(column: str) -> Column:
    """A text as a literal; nulls and empty texts make no triple."""
    return F.when(F.length(column) > 0, terms.typed_term(F.col(column), "string"))


def _number(column: str) -> Column:
    return terms.typed_term(F.col(column), "integer")


def _flag(column: str) -> Column:
    return terms.typed_term(F.coalesce(F.col(column), F.lit(False)), "boolean")


def _uri(column: str = "uri") -> Column:
    return terms.iri_term(F.col(column))


#: For each kind: predicates and the columns that fill them.
_FLAGS = {
    "function": {"isAsync": "is_async", "isGenerator": "is_generator", "isArrowFunction": "is_arrow_function", "isExported": "is_exported", "isDefaultExport": "is_default_export"},
    "class": {"isAbstract": "is_abstract", "isExported": "is_exported", "isDefaultExport": "is_default_export"},
    "interface": {"isExported": "is_exported"},
    "property": {"isStatic": "is_static", "isPrivate": "is_private", "isProtected": "is_protected", "isReadonly": "is_readonly"},
    "import": {"isTypeOnly": "is_type_only"},
    "export": {"isReExport": "is_re_export"},
    "call": {"isMethodCall": "is_method_call"},
}
_FLAGS["method"] = _FLAGS["function"] | {"isStatic": "is_static", "isPrivate": "is_private", "isProtected": "is_protected", "isConstructor": "is_constructor", "isGetter": "is_getter", "isSetter": "is_setter"}
_TEXTS = {
    "module": {"moduleType": "module_type"},
    "function": {"hasScope": "scope"},
    "method": {"hasScope": "scope"},
    "variable": {"hasScope": "scope", "initializationValue": "init"},
    "property": {"hasScope": "scope", "initializationValue": "init"},
    "parameter": {"hasDefaultValue": "init"},
    "import": {"modulePath": "module_path", "importType": "import_type", "hasAlias": "alias"},
    "export": {"exportType": "export_type", "hasAlias": "alias", "fromModule": "source_module"},
    "call": {"callsFunction": "callee_name"},
}
_LISTS = {"class": {"hasTypeParameter": "type_parameters"}, "interface": {"hasTypeParameter": "type_parameters"}, "import": {"importsSymbol": "imported_symbols"}}


def _pair(predicate: str, term: Column) -> Column:
    return F.struct(F.lit(predicate).alias("p"), term.alias("o"))


def node_triples(entities: DataFrame) -> DataFrame:
    """Triples (file_path, s, p, o) of each entity on its own: one pass, one explode."""
    kind = F.col("kind")
    pairs = [_pair(code("hasName"), _text("name")), _pair(code("hasURI"), terms.typed_term(F.col("uri"), "anyURI")), _pair(code("hasDocstring"), _text("docstring")), _pair(code("hasBodyHash"), _text("body_hash"))]
    for name, local in KINDS.items():
        pairs.append(_pair(RDF_TYPE, F.when(kind == name, F.lit(code(local)))))
        if local in WIDER:
            pairs.append(_pair(RDF_TYPE, F.when(kind == name, F.lit(code(WIDER[local])))))
        pairs += [_pair(code(p), F.when(kind == name, _flag(c))) for p, c in _FLAGS.get(name, {}).items()]
        pairs += [_pair(code(p), F.when(kind == name, _text(c))) for p, c in _TEXTS.get(name, {}).items()]
    declared = [_pair(code(p), F.when(kind == "variable", terms.typed_term(F.col("declared") == w, "boolean"))) for p, w in (("isConst", "const"), ("isLet", "let"), ("isVar", "var"))]
    own = F.element_at("parameters", 1)
    of_parameter = [_pair(code(p), F.when(kind == "parameter", terms.typed_term(F.coalesce(own[c], F.lit(False)), "boolean"))) for p, c in (("isRestParameter", "is_rest"), ("isOptional", "is_optional"))]
    place = F.concat(F.lit("_:l"), F.substring(F.sha1("uri"), 1, 20))
    pairs += [*declared, *of_parameter, _pair(code("locatedAt"), place)]
    flat = entities.select("file_path", _uri().alias("s"), F.explode(F.filter(F.array(*pairs), lambda x: x["o"].isNotNull())).alias("x")).select("file_path", "s", "x.p", "x.o")
    spots = [
        _pair(RDF_TYPE, F.lit(code("SourceLocation"))),
        _pair(code("filePath"), _text("file_path")),
        _pair(code("lineNumber"), _number("line_number")),
        _pair(code("columnNumber"), _number("column_number")),
        _pair(code("endLineNumber"), _number("end_line")),
        _pair(code("endColumnNumber"), F.when(F.col("end_column") > 0, _number("end_column"))),
    ]
    places = entities.select("file_path", place.alias("s"), F.explode(F.filter(F.array(*spots), lambda x: x["o"].isNotNull())).alias("x")).select("file_path", "s", "x.p", "x.o")
    return reduce(DataFrame.unionByName, [flat, places, *_lists(entities)])


def _lists(entities: DataFrame) -> list[DataFrame]:
    out = []
    for kind, columns in _LISTS.items():
        for predicate, column in columns.items():
            each = entities.where(F.col("kind") == kind).select("file_path", _uri().alias("s"), F.lit(code(predicate)).alias("p"), F.explode(column).alias("v"))
            out.append(each.select("file_path", "s", "p", terms.typed_term(F.col("v"), "string").alias("o")))
    arguments = entities.where("kind = 'call'").select("file_path", "uri", F.posexplode("arguments").alias("at", "v"))
    node = F.concat(F.lit("_:g"), F.substring(F.sha1(F.concat_ws("|", "uri", "at")), 1, 20))
    out.append(arguments.select("file_path", _uri().alias("s"), F.lit(code("hasArgument")).alias("p"), node.alias("o")))
    out.append(arguments.select("file_path", node.alias("s"), F.lit(code("argumentPosition")).alias("p"), terms.typed_term(F.col("at"), "integer").alias("o")))
    out.append(arguments.select("file_path", node.alias("s"), F.lit(code("argumentValue")).alias("p"), terms.typed_term(F.col("v"), "string").alias("o")))
    comments = entities.select("file_path", "uri", F.posexplode("comments").alias("at", "v"))
    node = F.concat(F.lit("_:k"), F.substring(F.sha1(F.concat_ws("|", "uri", "at")), 1, 20))
    out.append(comments.select("file_path", _uri().alias("s"), F.lit(code("hasComment")).alias("p"), node.alias("o")))
    out.append(comments.select("file_path", node.alias("s"), F.lit(code("commentText")).alias("p"), terms.typed_term(F.col("v"), "string").alias("o")))
    return out


def relation_edges(entities: DataFrame) -> DataFrame:
    """(src, dst, relationship) between entities that are both known.

    Names of classes and interfaces are resolved in the entity's own file
    first, then anywhere, the first by file and place.
    """
    out = [resolved_calls(entities).select("src", "dst", F.lit("calls").alias("relationship"))]
    members = entities.where("parent_uri is not null").select(F.col("parent_uri").alias("src"), F.col("uri").alias("dst"), "kind")
    out.append(members.select("src", "dst", F.when(F.col("kind") == "method", "hasMethod").when(F.col("kind") == "property", "hasProperty").otherwise("hasParameter").alias("relationship")))
    modules = entities.where("kind = 'module'").select("file_path", F.col("uri").alias("src"))
    defined = entities.where("kind in ('function', 'class')").select("file_path", F.col("uri").alias("dst"))
    out.append(modules.join(defined, "file_path").select("src", "dst", F.lit("defines").alias("relationship")))
    exported = entities.where("is_exported").select("file_path", F.col("uri").alias("dst"))
    out.append(modules.join(exported, "file_path").select("src", "dst", F.lit("exports").alias("relationship")))
    imports = module_imports(entities).select("file_path", F.col("target").alias("to"))
    out.append(imports.join(modules, "file_path").join(modules.select(F.col("file_path").alias("to"), F.col("src").alias("dst")), "to").select("src", "dst", F.lit("imports").alias("relationship")))
    types = entities.where("kind in ('class', 'interface')").select("kind", "name", "file_path", "uri", "ordinal")
    for kind, relationship, names in (("class", "extends", F.array("extends_class")), ("interface", "implements", F.col("implements"))):
        wanted = entities.where("kind = 'class'").select(F.col("uri").alias("src"), "file_path", F.explode(names).alias("name")).where("name is not null")
        known = types.where(F.col("kind") == kind).select("name", F.col("file_path").alias("at"), F.col("uri").alias("dst"), "ordinal")
        found = wanted.join(known, "name").groupBy("src", "name").agg(F.min_by("dst", F.struct(F.col("at") != F.col("file_path"), "at", "ordinal")).alias("dst"))
        out.append(found.select("src", "dst", F.lit(relationship).alias("relationship")))
    variables = entities.where("kind = 'variable'").select("file_path", F.col("name").alias("variable"), F.col("uri").alias("dst"))
    uses = entities.where("kind in ('function', 'method')").select(F.col("uri").alias("src"), "file_path", F.explode("accesses").alias("variable"))
    out.append(uses.join(variables, ["file_path", "variable"]).select("src", "dst", F.lit("accesses").alias("relationship")))
    return reduce(DataFrame.unionByName, out).distinct()


#: The predicate of the opposite direction, where it is stored too.
OPPOSITE = {"calls": "calledBy", "hasMethod": "memberOf", "hasProperty": "memberOf", "defines": "declaredIn"}


def owner(uri: Column) -> Column:
    """The file that an entity's URI names."""
    return F.regexp_extract(uri, f"^{re.escape(BASE)}(.*)#[^#]*$", 1)


def relation_triples(entities: DataFrame) -> DataFrame:
    """Triples (file_path, s, p, o) between entities, in both directions where a predicate names the other.

    A relation belongs to the file of its source, its opposite too.
    """
    edges = stage(entities.sparkSession, relation_edges(entities).withColumn("file_path", owner(F.col("src"))), "lowered-edges")
    names = {"accesses": "references"}
    label = F.coalesce(*[F.when(F.col("relationship") == k, F.lit(code(v))) for k, v in names.items()], F.concat(F.lit(f"<{CODE}"), "relationship", F.lit(">")))
    forward = edges.select("file_path", _uri("src").alias("s"), label.alias("p"), _uri("dst").alias("o"))
    back = F.coalesce(*[F.when(F.col("relationship") == k, F.lit(code(v))) for k, v in OPPOSITE.items()])
    backward = edges.where(F.col("relationship").isin(list(OPPOSITE))).select("file_path", _uri("dst").alias("s"), back.alias("p"), _uri("src").alias("o"))
    calls = entities.where("kind = 'call'").select("file_path", "uri", "caller_uri", "callee_name")
    made = calls.select("file_path", _uri().alias("s"), F.lit(code("madeBy")).alias("p"), _uri("caller_uri").alias("o"))
    at = calls.select("file_path", _uri().alias("s"), F.lit(code("calledAt")).alias("p"), F.concat(F.lit("_:l"), F.substring(F.sha1("uri"), 1, 20)).alias("o"))
    callees = entities.where("kind in ('function', 'method')").select(F.col("uri").alias("dst"), F.col("name").alias("last"))
    hit = calls.withColumn("last", F.substring_index("callee_name", ".", -1)).join(edges.where("relationship = 'calls'").join(callees, "dst").select(F.col("src").alias("caller_uri"), "last", "dst"), ["caller_uri", "last"])
    resolved = hit.select("file_path", _uri().alias("s"), F.lit(code("callsFunction")).alias("p"), _uri("dst").alias("o"))
    depends = entities.where("kind = 'import'").join(entities.where("kind = 'module'").select("file_path", F.col("uri").alias("module")), "file_path")
    depends = depends.select("file_path", _uri("module").alias("s"), F.lit(code("dependsOn")).alias("p"), terms.typed_term(F.col("module_path"), "string").alias("o"))
    return reduce(DataFrame.unionByName, [forward, backward, made, at, resolved, depends]).distinct()


def lower_by_file(entities: DataFrame) -> DataFrame:
    """All triples of entities with the file that each belongs to: (file_path, s, p, o), as a set."""
    # Written: nearly every part below reads them.
    entities = stage(entities.sparkSession, first_by_uri(entities), "lowered-entities")
    return node_triples(entities).unionByName(relation_triples(entities)).distinct()


def lower(entities: DataFrame) -> DataFrame:
    """All triples (s, p, o) of entities, as a set."""
    return lower_by_file(entities).select("s", "p", "o").distinct()


def heritage(entities: DataFrame) -> DataFrame:
    """(file_path, name) of the classes and interfaces that classes name as theirs."""
    named = F.concat(F.array_compact(F.array("extends_class")), F.coalesce("implements", F.array().cast("array<string>")))
    return entities.where("kind = 'class'").select("file_path", F.explode(named).alias("name")).distinct()


def touched(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path) of the files whose triples a change of files (file_path) may alter.

    ``entities`` are those before and after.  They are the changed files, those
    that import one of them, and those whose classes name one of theirs.
    """
    own = changed.select("file_path").distinct()
    importers = module_imports(entities).join(own.withColumnRenamed("file_path", "target"), "target", "left_semi").select("file_path")
    types = entities.where("kind in ('class', 'interface')").select("file_path", "name").join(own, "file_path", "left_semi")
    heirs = heritage(entities).join(types.select("name").distinct(), "name", "left_semi").select("file_path")
    return own.union(importers).union(heirs).distinct()


def context(entities: DataFrame, files: DataFrame) -> DataFrame:
    """The entities that the triples of ``files`` (file_path) depend on: their own, those of imported files, and the types they name."""
    own = files.select("file_path").distinct()
    imported = module_imports(entities).join(own, "file_path", "left_semi").select(F.col("target").alias("file_path"))
    names = heritage(entities).join(own, "file_path", "left_semi").select("name").distinct()
    types = entities.where("kind in ('class', 'interface')").join(names, "name", "left_semi").select("file_path")
    return entities.join(own.union(imported).union(types).distinct(), "file_path", "left_semi")


def relower(entities: DataFrame, files: DataFrame) -> DataFrame:
    """The triples (file_path, s, p, o) that belong to ``files`` (file_path), lowered from no more than they depend on."""
    return lower_by_file(context(entities, files)).join(files.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "s", "p", "o")


def property_graph(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, name, type, location, line_number, attrs) and edges (src, dst, relationship, type)."""
    entities = first_by_uri(entities)
    classes = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    attrs = F.map_filter(F.create_map(F.lit("docstring"), F.col("docstring"), F.lit("body_hash"), F.col("body_hash"), F.lit("scope"), F.col("scope")), lambda k, v: v.isNotNull())
    vertices = entities.select(F.col("uri").alias("id"), "name", classes[F.col("kind")].alias("type"), F.col("file_path").alias("location"), "line_number", attrs.alias("attrs"))
    edges = relation_edges(entities).where("relationship in ('calls', 'extends', 'implements', 'accesses', 'imports', 'hasMethod')")
    return vertices, edges.select("src", "dst", "relationship", F.col("relationship").alias("type"))
