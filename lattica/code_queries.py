"""Registered queries over a generated code base: from text to entities, triples, spans, files and back.

Every supplier becomes one source file, whose text is made of its columns; its
neighbour by key is the file it imports.  So what extraction and lowering must
find can be said in SQL over the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import pipeline, star
from lattica.engine import QueryEngine
from lattica.functions import terms
from lattica.functions.staging import shared_dir, stage
from lattica.functions.terms import CODE, KG
from lattica.graph import Graph
from lattica.model import BASE
from lattica.operators import analytics, extract, lowering, paths, semantic, spans, validate
from lattica.plans import patterns, templates
from lattica.plans.compiler import sparql
from lattica.queries import CALLS, _supplier, query, text_query
from lattica.sources import files, property_graph, rdf
from lattica.sources.store import Store
from lattica.streaming import changes
from lattica.streaming.updater import Updater

#: The text of a file: ``{k}`` is its supplier's key, ``{d}`` that of the file it imports, ``{n}`` the nation.
LINES = (
    "import {{ work{d} }} from './f{d}';",
    "import * as far from './gone{k}';",
    "",
    "/** Takes orders of nation {n}, à la carte. */",
    "export async function work{k}(order, count = {n}, ...rest) {{",
    "  const total = order * count;",
    "  save{k}(total);",
    "  return work{d}(order);",
    "}}",
    "function save{k}(x) {{ return far.more(x); }}",
    "export class Box{k} extends Box{d} implements Shape{k} {{",
    "  constructor(size) {{ this.size = size; }}",
    "  find(part) {{ return save{k}(part); }}",
    "  static made = {n};",
    "}}",
    "interface Shape{k} {{ size: number }}",
    "const box = new Box{k}({n});",
    "export {{ save{k} as help{k} }};",
)


def _filled(line: str) -> str:
    """A line as an SQL expression over k, d and n (for DuckDB and for Spark)."""
    text = line.replace("{{", "\0").replace("}}", "\1").replace("'", "''")
    for name in ("k", "d", "n"):
        text = text.replace(f"{{{name}}}", f"' || {name} || '")
    return "'" + text.replace("\0", "{").replace("\1", "}") + "'"


#: The files in SQL: their keys, and the bytes ahead of the function save, which stands on the tenth line.
TEXT = " || chr(10) || ".join(map(_filled, LINES))
AHEAD = " || chr(10) || ".join(map(_filled, LINES[:9])) + " || chr(10) || 'function '"
SRC = f"src AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_suppkey + 3) % (SELECT count(*) FROM supplier) AS d, 'src/f' || s_suppkey || '.ts' AS file, '{BASE}src/f' || s_suppkey || '.ts#' AS u, '{BASE}src/f' || ((s_suppkey + 3) % (SELECT count(*) FROM supplier)) || '.ts#' AS du FROM supplier)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the files."""
    suppliers = star.table(spark, sf_dir, "supplier")
    n = suppliers.agg(F.count(F.lit(1)).alias("all"))
    keyed = suppliers.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), ((F.col("s_suppkey") + 3) % F.col("all")).alias("d"))  # one row
    return keyed.select(F.concat(F.lit("src/f"), F.col("k").cast("string"), F.lit(".ts")).alias("path"), F.expr(TEXT).alias("content"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, extract.extract(sources(spark, sf_dir)), "code-entities")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(stage(spark, lowering.lower(entities(spark, sf_dir)), "code-triples"))


def _joined(column: str):
    return F.coalesce(F.array_join(column, ","), F.lit("")).alias(column)


# Extraction.
_KINDS = {"module": 1, "import": 2, "function": 2, "parameter": 6, "variable": 2, "call": 5, "class": 1, "method": 2, "property": 1, "interface": 1, "export": 1}


@query(f"WITH {SRC}, kinds AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _KINDS.items())}) v(kind, each)) SELECT kind, (each * (SELECT count(*) FROM src))::BIGINT AS n FROM kinds")
def code_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SRC} SELECT u || 'module' AS uri, 'f' || k AS name, 'esm' AS module_type, substr(sha256({TEXT}), 1, 16) AS body_hash, 18 AS end_line FROM src")
def code_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).where("kind = 'module'").select("uri", "name", "module_type", "body_hash", "end_line")


@query(
    f"WITH {SRC} SELECT u || 'function_work' || k || '_5' AS uri, 'work' || k AS name, 5 AS line_number, 22 AS column_number, true AS is_async, true AS is_exported, 'order,count,rest' AS names, 'Takes orders of nation ' || n || ', à la carte.' AS docstring, 'save' || k || ',work' || d AS calls, 'global' AS scope FROM src "
    f"UNION ALL SELECT u || 'function_save' || k || '_10', 'save' || k, 10, 9, false, true, 'x', NULL, 'far.more', 'global' FROM src"
)
def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(sources(spark, sf_dir)).where("kind = 'function'")
    names = F.array_join(F.col("parameters.name"), ",").alias("names")
    return found.select("uri", "name", "line_number", "column_number", "is_async", "is_exported", names, "docstring", _joined("calls"), "scope")


@query(
    f"WITH {SRC} SELECT u || 'method_constructor_12' AS uri, u || 'class_Box' || k || '_11' AS parent_uri, true AS is_constructor, '' AS calls, 'Box' || k AS scope, substr(sha256('constructor(size) {{ this.size = size; }}'), 1, 16) AS body_hash FROM src "
    f"UNION ALL SELECT u || 'method_find_13', u || 'class_Box' || k || '_11', false, 'save' || k, 'Box' || k, substr(sha256('find(part) {{ return save' || k || '(part); }}'), 1, 16) FROM src"
)
def code_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(sources(spark, sf_dir)).where("kind = 'method'")
    return found.select("uri", "parent_uri", "is_constructor", _joined("calls"), "scope", "body_hash")


@query(
    f"WITH {SRC}, p AS (SELECT * FROM (VALUES ('order', 5, false, false, 'w'), ('count', 5, true, false, 'w'), ('rest', 5, false, true, 'w'), ('x', 10, false, false, 's'), ('size', 12, false, false, 'c'), ('part', 13, false, false, 'f')) v(name, line, has_default, is_rest, owner)) "
    "SELECT u || 'parameter_' || name || '_' || line AS uri, name, CASE WHEN has_default THEN n::VARCHAR END AS default_value, is_rest, has_default AS is_optional, u || CASE owner WHEN 'w' THEN 'function_work' || k || '_5' WHEN 's' THEN 'function_save' || k || '_10' WHEN 'c' THEN 'method_constructor_12' ELSE 'method_find_13' END AS parent_uri FROM src, p"
)
def code_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(sources(spark, sf_dir)).where("kind = 'parameter'").withColumn("own", F.element_at("parameters", 1))
    return found.select("uri", "name", "own.default_value", "own.is_rest", "own.is_optional", "parent_uri")


@query(
    f"WITH {SRC} SELECT file AS file_path, 'import_f' || d AS name, './f' || d AS module_path, 'named' AS import_type, 'work' || d AS imported_symbols, NULL AS alias FROM src UNION ALL SELECT file, 'import_gone' || k, './gone' || k, 'namespace', '', 'far' FROM src"
)
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).where("kind = 'import'").select("file_path", "name", "module_path", "import_type", _joined("imported_symbols"), "alias")


@query(f"WITH {SRC} SELECT file AS file_path, 'save' || k AS name, 'help' || k AS alias, 'named' AS export_type, false AS is_re_export FROM src")
def code_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).where("kind = 'export'").select("file_path", "name", "alias", "export_type", "is_re_export")


@query(f"WITH {SRC} SELECT 'class' AS kind, 'Box' || k AS name, 'Box' || d AS extends_class, 'Shape' || k AS implements, true AS is_exported, 11 AS line_number, 15 AS end_line FROM src UNION ALL SELECT 'interface', 'Shape' || k, NULL, '', false, 16, 16 FROM src")
def code_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).where("kind in ('class', 'interface')").select("kind", "name", "extends_class", _joined("implements"), "is_exported", "line_number", "end_line")


@query(
    f"WITH {SRC} SELECT 'variable' AS kind, 'total' AS name, 'const' AS declared, 'order * count' AS init, 'work' || k AS scope, NULL::BOOLEAN AS is_static, file AS file_path FROM src UNION ALL SELECT 'variable', 'box', 'const', 'new Box' || k || '(' || n || ')', 'global', NULL, file FROM src UNION ALL SELECT 'property', 'made', NULL, n::VARCHAR, 'Box' || k, true, file FROM src"
)
def code_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).where("kind in ('variable', 'property')").select("kind", "name", "declared", "init", "scope", "is_static", "file_path")


@query(
    f"WITH {SRC} SELECT u || 'function_work' || k || '_5' AS caller_uri, 'save' || k AS callee_name, 'total' AS arguments, 7 AS line_number, false AS is_method_call FROM src UNION ALL SELECT u || 'function_work' || k || '_5', 'work' || d, 'order', 8, false FROM src "
    f"UNION ALL SELECT u || 'function_save' || k || '_10', 'far.more', 'x', 10, true FROM src UNION ALL SELECT u || 'method_find_13', 'save' || k, 'part', 13, false FROM src UNION ALL SELECT u || 'module', 'Box' || k, n::VARCHAR, 17, false FROM src"
)
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(sources(spark, sf_dir)).where("kind = 'call'").select("caller_uri", "callee_name", _joined("arguments"), "line_number", F.coalesce("is_method_call", F.lit(False)).alias("is_method_call"))


_EDGES = f"{SRC}, edges AS (SELECT u || 'function_work' || k || '_5' AS src, u || 'function_save' || k || '_10' AS dst FROM src UNION ALL SELECT u || 'function_work' || k || '_5', du || 'function_work' || d || '_5' FROM src UNION ALL SELECT u || 'method_find_13', u || 'function_save' || k || '_10' FROM src)"


@query(f"WITH {_EDGES} SELECT * FROM edges")
def code_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.resolved_calls(entities(spark, sf_dir))


@query(f"WITH {SRC} SELECT file AS file_path, 'src/f' || d || '.ts' AS target, 'work' || d AS symbols FROM src")
def code_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.module_imports(entities(spark, sf_dir)).select("file_path", "target", F.array_join("imported_symbols", ",").alias("symbols"))


@query(f"WITH {SRC}, l AS (SELECT file, unnest(string_split({TEXT}, chr(10))) AS text, generate_subscripts(string_split({TEXT}, chr(10)), 1) AS line FROM src) SELECT file, line::BIGINT AS line, regexp_extract(text, 'from ''([^'']+)''', 1) AS module_path FROM l WHERE text LIKE 'import %'")
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import statements, line by line."""
    lines = sources(spark, sf_dir).select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return semantic.line_imports(lines).select("file", F.col("line").cast("long").alias("line"), "module_path")


# Lowering.
def _code(local: str) -> str:
    return f"'<{CODE}{local}>'"


def _pair(one: str, other: str, forth: str, back: str | None = None) -> str:
    out = f"SELECT '<' || {one} || '>' AS s, {_code(forth)} AS p, '<' || {other} || '>' AS o FROM src"
    return out + (f" UNION ALL SELECT '<' || {other} || '>', {_code(back)}, '<' || {one} || '>' FROM src" if back else "")


_WORK, _SAVE, _FIND, _MADE, _BOX, _MODULE = "u || 'function_work' || k || '_5'", "u || 'function_save' || k || '_10'", "u || 'method_find_13'", "u || 'property_made_14'", "u || 'class_Box' || k || '_11'", "u || 'module'"
_RELATIONS = " UNION ALL ".join(
    [
        _pair(_WORK, _SAVE, "calls", "calledBy"),
        _pair(_WORK, "du || 'function_work' || d || '_5'", "calls", "calledBy"),
        _pair(_FIND, _SAVE, "calls", "calledBy"),
        _pair(_BOX, _FIND, "hasMethod", "memberOf"),
        _pair(_BOX, "u || 'method_constructor_12'", "hasMethod", "memberOf"),
        _pair(_BOX, _MADE, "hasProperty", "memberOf"),
        *(_pair(_MODULE, x, "defines", "declaredIn") for x in (_WORK, _SAVE, _BOX)),
        *(_pair(_MODULE, x, "exports") for x in (_WORK, _SAVE, _BOX)),
        _pair(_MODULE, "du || 'module'", "imports"),
        _pair(_BOX, "du || 'class_Box' || d || '_11'", "extends"),
        _pair(_BOX, "u || 'interface_Shape' || k || '_16'", "implements"),
        _pair(_WORK, "u || 'variable_total_6'", "references"),
        *(_pair(_WORK, f"u || 'parameter_{x}_5'", "hasParameter") for x in ("order", "count", "rest")),
        _pair(_SAVE, "u || 'parameter_x_10'", "hasParameter"),
        _pair("u || 'method_constructor_12'", "u || 'parameter_size_12'", "hasParameter"),
        _pair(_FIND, "u || 'parameter_part_13'", "hasParameter"),
    ]
)
_NAMES = "calls calledBy hasMethod memberOf hasProperty defines declaredIn exports imports extends implements references hasParameter".split()


@query(f"WITH {SRC} {_RELATIONS}")
def code_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).scan().where(F.col("p").isin([f"<{CODE}{name}>" for name in _NAMES])).select("s", "p", "o")


def _literals(rows: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '<' || {_WORK} || '>' AS s, {_code(p)} AS p, {o} AS o FROM src" for p, o in rows.items())


def _flag(value: bool) -> str:
    return f"'\"{str(value).lower()}\"^^<{terms.XSD}boolean>'"


_FLAGS = {"isAsync": True, "isGenerator": False, "isArrowFunction": False, "isExported": True, "isDefaultExport": False}
_BODY = " || chr(10) || ".join(map(_filled, [LINES[4].removeprefix("export async function "), *LINES[5:9]]))


@query(
    f"WITH {SRC} "
    + _literals({p: _flag(v) for p, v in _FLAGS.items()} | {"hasName": "'\"work' || k || '\"'", "hasScope": "'\"global\"'", "hasDocstring": "'\"Takes orders of nation ' || n || ', à la carte.\"'", "hasBodyHash": f"'\"' || substr(sha256({_BODY}), 1, 16) || '\"'", "hasURI": f"'\"' || {_WORK} || '\"^^<{terms.XSD}anyURI>'"})
    + f" UNION ALL SELECT '<' || {_WORK} || '>', '{terms.RDF_TYPE}', {_code('Function')} FROM src"
)
def code_function_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each work function by itself."""
    wanted = [f"<{CODE}{p}>" for p in (*_FLAGS, "hasName", "hasScope", "hasDocstring", "hasBodyHash", "hasURI")] + [terms.RDF_TYPE]
    return graph(spark, sf_dir).scan().where(F.col("s").rlike("#function_work[0-9]+_5>$") & F.col("p").isin(wanted)).select("s", "p", "o")


#: Entities in each file, and triples of each predicate that every entity has.
_EACH = sum(_KINDS.values())


@query(
    f"WITH {SRC}, per AS (SELECT * FROM (VALUES ('hasName', {_EACH}), ('hasURI', {_EACH}), ('locatedAt', {_EACH}), ('filePath', {_EACH}), ('lineNumber', {_EACH}), ('columnNumber', {_EACH}), ('endLineNumber', {_EACH}), ('endColumnNumber', {_EACH}), "
    "('moduleType', 1), ('modulePath', 2), ('importType', 2), ('dependsOn', 2), ('importsSymbol', 1), ('isConst', 2), ('isLet', 2), ('isVar', 2), ('isRestParameter', 6), ('isOptional', 6), ('hasDefaultValue', 1), ('exportType', 1), ('isReExport', 1), ('isTypeOnly', 2), "
    "('hasArgument', 5), ('argumentPosition', 5), ('argumentValue', 5), ('madeBy', 5), ('calledAt', 5), ('isMethodCall', 5), ('isAsync', 4), ('isConstructor', 2), ('isAbstract', 1), ('isReadonly', 1), ('initializationValue', 3), ('hasAlias', 2), ('hasDocstring', 1), ('callsFunction', 8)) v(name, each)) "
    "SELECT name, (each * (SELECT count(*) FROM src))::BIGINT AS n FROM per"
)
def code_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the predicates that code_relations leaves out; a call names its callee, and leads to it where it is known."""
    name = F.regexp_extract("p", f"^<{CODE}(.*)>$", 1).alias("name")
    counted = graph(spark, sf_dir).scan().groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(~F.col("name").isin(["", *_NAMES, "hasScope", "hasBodyHash", "isGenerator", "isArrowFunction", "isExported", "isDefaultExport", "isStatic", "isPrivate", "isProtected", "isGetter", "isSetter"]))


@query(f"WITH {_EDGES} SELECT src, dst, 'calls' AS relationship FROM edges UNION ALL SELECT {_BOX}, du || 'class_Box' || d || '_11', 'extends' FROM src UNION ALL SELECT {_BOX}, u || 'interface_Shape' || k || '_16', 'implements' FROM src UNION ALL SELECT {_WORK}, u || 'variable_total_6', 'accesses' FROM src UNION ALL SELECT {_MODULE}, du || 'module', 'imports' FROM src UNION ALL SELECT {_BOX}, {_FIND}, 'hasMethod' FROM src UNION ALL SELECT {_BOX}, u || 'method_constructor_12', 'hasMethod' FROM src")
def code_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lowering.property_graph(entities(spark, sf_dir))[1].select("src", "dst", "relationship")


@query(f"WITH {SRC} SELECT {_WORK} AS id, 'work' || k AS name, 'Function' AS type, file AS location, 5 AS line_number, 'global' AS scope FROM src")
def code_graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lowering.property_graph(entities(spark, sf_dir))[0].where("type = 'Function' and name like 'work%'")
    return found.select("id", "name", "type", "location", "line_number", F.col("attrs")["scope"].alias("scope"))


@query("SELECT l_orderkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1 AND l_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1 HAVING max(n) = 1)")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the entities that share an identity: orders stand for identities, their lines for entities."""
    lines = star.table(spark, sf_dir, "lineitem")
    clear = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n")).groupBy("l_orderkey").agg(F.max("n").alias("n")).where("n = 1")
    found = lowering.first_by_uri(lines.join(clear.select("l_orderkey"), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("file_path"), F.col("l_partkey").alias("ordinal"), "l_suppkey", "l_quantity"))
    return found.select(F.col("uri").alias("l_orderkey"), "l_suppkey", "l_quantity")


@query("WITH v AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment FROM customer), last AS (SELECT nation, segment, max(k) AS k FROM v GROUP BY 1, 2) SELECT nation::VARCHAR AS file_path, segment AS name, 'f' || k AS dst FROM last")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls lead to the last definition of a name in a file: customers of a nation and segment define one name."""
    customers = star.table(spark, sf_dir, "customer")
    none = F.lit(None).cast("array<string>")
    defined = customers.select(F.col("c_nationkey").cast("string").alias("file_path"), F.lit("function").alias("kind"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("uri"), F.col("c_custkey").alias("ordinal"), none.alias("calls"))
    calling = defined.groupBy("file_path").agg(F.collect_set("name").alias("calls")).select("file_path", F.lit("function").alias("kind"), F.lit("main").alias("name"), F.concat(F.lit("main"), "file_path").alias("uri"), F.lit(-1).cast("long").alias("ordinal"), "calls")
    text = [F.lit(None).cast("string").alias(c) for c in ("module_path", "init", "parent_uri")]
    rows = defined.unionByName(calling).select("*", *text, none.alias("imported_symbols"))
    edges = extract.resolved_calls(rows)
    named = defined.select(F.col("uri").alias("dst"), "file_path", "name")
    return edges.join(named, "dst").select("file_path", "name", "dst")


# Spans.
@query(f"WITH {SRC}, t AS (SELECT *, octet_length(encode({AHEAD}))::BIGINT AS b, 'save' || k || '(x) {{ return far.more(x); }}' AS part FROM src) SELECT {_SAVE} AS uri, b AS byte_start, b + octet_length(encode(part)) AS byte_end, 10 AS line_start, 10 AS line_end, sha256(part) AS content_hash, sha256(part) AS ast_hash, part AS preview FROM t")
def code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sources(spark, sf_dir).withColumnRenamed("content", "text")
    found = spans.spans(entities(spark, sf_dir), texts).where("uri like '%#function_save%'")
    return found.select("uri", F.col("byte_start").cast("long").alias("byte_start"), F.col("byte_end").cast("long").alias("byte_end"), "line_start", "line_end", "content_hash", "ast_hash", "preview")


@query(
    f"WITH {SRC} SELECT 'blob:git://local@WORKING:' || file AS blob, 'typescript' AS language, sha256({TEXT}) AS content_hash, {_EACH - 6}::BIGINT AS spans FROM src"
)
def code_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs with the spans that lie in them; parameters have none."""
    texts = sources(spark, sf_dir).withColumnRenamed("content", "text")
    rows = Graph.of(stage(spark, spans.span_triples(spans.spans(entities(spark, sf_dir), texts), texts), "code-spans"))
    found = sparql(rows, "SELECT ?blob ?language ?content_hash (COUNT(?span) AS ?spans) WHERE { ?blob a code:Blob ; code:language ?language ; code:contentHash ?content_hash . ?span code:inBlob ?blob } GROUP BY ?blob ?language ?content_hash")
    return found.withColumn("spans", F.col("spans").cast("long"))


@query(f"WITH {SRC} SELECT file AS path, 'typescript' AS language, sha256({TEXT}) AS content_hash, substr(sha256({TEXT}), 1, 16) AS short_hash FROM src")
def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as they are and read as sources."""
    folder = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}"
    rows = sources(spark, sf_dir).select("path", F.col("content").alias("value"))
    rows.select(F.regexp_extract("path", r"([^/]+)\.ts$", 1).alias("name"), "value").repartition("name").write.partitionBy("name").option("lineSep", "\n").text(folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.concat(F.lit("src/"), F.regexp_extract("path", r"name=([^/]+)/", 1), F.lit(".ts"))
    # A text file ends with a line break.
    content = F.expr("substring(content, 1, length - 1)")
    return found.select(path.alias("path"), content.alias("content")).select("path", files.language(F.col("path")).alias("language"), files.content_hash(F.col("content")).alias("content_hash"), files.short_hash(F.col("content")).alias("short_hash"))


# Questions over the lowered graph.
def _ask(name: str, sql: str, sentence: str) -> None:
    query(f"WITH {SRC} {sql}", name)(lambda spark, sf_dir: QueryEngine(graph(spark, sf_dir)).ask_sentence(sentence).df)


def _filled_template(name: str, sql: str, **values: object) -> None:
    query(f"WITH {SRC} {sql}", f"template_{name}")(lambda spark, sf_dir: QueryEngine(graph(spark, sf_dir)).template(name, **values).df)


_filled_template("classes_implementing_interface", f"SELECT {_BOX} AS class, 'Box' || k AS className FROM src WHERE k = 1", interface=f"{BASE}src/f1.ts#interface_Shape1_16")
_filled_template("functions_in_module", f"SELECT {_WORK} AS function, 'work' || k AS functionName FROM src WHERE k = 1 UNION ALL SELECT {_SAVE}, 'save' || k FROM src WHERE k = 1", module=f"{BASE}src/f1.ts#module")
_filled_template("variables_accessed_by_function", "SELECT u || 'variable_total_6' AS variable, 'total' AS varName FROM src WHERE k = 1", function=f"{BASE}src/f1.ts#function_work1_5")
_filled_template("database_operations", f"SELECT {_WORK} AS function, 'work' || k AS functionName FROM src UNION ALL SELECT {_FIND}, 'find' FROM src")
_filled_template("functions_with_many_parameters", f"SELECT {_WORK} AS function, 'work' || k AS functionName, '3' AS paramCount FROM src", param_threshold=2)
_ask("sentence_functions_calling", "SELECT u || 'function_work' || k || '_5' AS caller, 'work' || k AS callerName FROM src WHERE k = 1 UNION ALL SELECT u || 'method_find_13', 'find' FROM src WHERE k = 1", "Find functions calling save1")
_ask("sentence_classes_implementing", f"SELECT {_BOX} AS class, 'Box' || k AS className FROM src WHERE k = 2", "Which classes implement Shape2?")
_ask("sentence_unused", f"SELECT {_FIND} AS function, 'find' AS functionName FROM src UNION ALL SELECT u || 'method_constructor_12', 'constructor' FROM src", "Find unused functions")


@query(f"WITH {SRC} SELECT 'save' || k AS name, 'work' || d AS other FROM src")
def code_engine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the functions called by work are called, from text to answer."""
    kg = pipeline.from_files(spark, sources(spark, sf_dir), with_spans=False)
    found = kg.query('SELECT ?name ?other WHERE { ?f code:calls ?a ; code:calls ?b ; code:isAsync true . ?a code:hasName ?name ; code:isAsync false . ?b code:hasName ?other ; code:isAsync true }')
    return found.df


@query(
    f"WITH {SRC}, near AS ({_RELATIONS}), one AS (SELECT s, p, o FROM near WHERE s = '<{BASE}src/f1.ts#interface_Shape1_16>' OR o = '<{BASE}src/f1.ts#interface_Shape1_16>') SELECT CASE WHEN s LIKE '%interface%' THEN 'outgoing' ELSE 'incoming' END AS direction, 1 AS hop, substr(s, 2, length(s) - 2) AS s, substr(p, 2, length(p) - 2) AS p, substr(o, 2, length(o) - 2) AS o, 'Box1' AS label FROM one"
    f" UNION ALL SELECT 'incoming', 2, du2, '{CODE}extends', u || 'class_Box1_11', 'Box' || k2 FROM (SELECT '{BASE}src/f' || k || '.ts#class_Box' || k || '_11' AS du2, k AS k2, '{BASE}src/f1.ts#' AS u FROM src WHERE d = 1)"
    f" UNION ALL SELECT 'outgoing', 2, {_BOX}, '{CODE}extends', du || 'class_Box' || d || '_11', 'Box' || d FROM src WHERE k = 1"
    f" UNION ALL SELECT 'outgoing', 2, {_BOX}, '{CODE}implements', u || 'interface_Shape1_16', 'Shape1' FROM src WHERE k = 1"
)
def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops around an interface over heritage."""
    return QueryEngine(graph(spark, sf_dir)).context(f"{BASE}src/f1.ts#interface_Shape1_16", 2, ["implements", "extends"]).df


# Semantic references.
def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as a server would give them: ends as keys of places a line off the definitions."""
    keyed = sources(spark, sf_dir).select("path", F.regexp_extract("path", r"f(\d+)", 1).alias("k"), F.regexp_extract("content", r"from './f(\d+)'", 1).alias("d"))
    source = semantic.symbol_key(F.col("path"), F.concat(F.lit("work"), "k"), F.lit(6), F.lit(0))
    target = semantic.symbol_key(F.concat(F.lit("src/f"), "d", F.lit(".ts")), F.concat(F.lit("save"), "d"), F.lit(9), F.lit(1))
    return keyed.select(source.alias("source_uri"), target.alias("target_uri"), F.lit("calls").alias("reference_type"), F.col("path").alias("file_path"), F.lit(8).alias("line_number"), F.lit("").alias("context"))


_TO_SAVE = "du || 'function_save' || d || '_10'"


@query(f"WITH {SRC} SELECT {_WORK} AS source_uri, {_TO_SAVE} AS target_uri, file AS file_path FROM src")
def semantic_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.resolve(_references(spark, sf_dir), entities(spark, sf_dir)).select("source_uri", "target_uri", "file_path")


@query(f"WITH {SRC} SELECT {_WORK} AS uri, {_TO_SAVE} AS calls_uris, '' AS called_by_uris FROM src UNION ALL SELECT {_SAVE}, '', (SELECT b.u || 'function_work' || b.k || '_5' FROM src b WHERE b.d = src.k) FROM src")
def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with the resolved calls of a server."""
    found = semantic.merge(entities(spark, sf_dir).where("kind = 'function'"), _references(spark, sf_dir))
    return found.select("uri", _joined("calls_uris"), _joined("called_by_uris"))


@query(f"WITH {SRC} SELECT file AS file_path, 'src/f' || d || '.ts' AS defined_in FROM src")
def semantic_cross_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities(spark, sf_dir)
    known = found.where("kind = 'function'").select(F.col("uri").alias("key"), "file_path")
    return semantic.cross_file(semantic.resolve(_references(spark, sf_dir), found), known).select("file_path", "defined_in")


@query(f"WITH {SRC} SELECT {_WORK} AS source_uri, {_TO_SAVE} AS target_uri, 'calls' AS reference_type FROM src UNION ALL SELECT {_BOX}, {_BOX}, 'references' FROM src")
def semantic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server's symbols, uses and calls, resolved to entities; a class is named where it stands."""
    keyed = sources(spark, sf_dir).select(F.col("path").alias("file_path"), F.regexp_extract("path", r"f(\d+)", 1).alias("k"), F.regexp_extract("content", r"from './f(\d+)'", 1).alias("d"))
    rows = [F.struct(F.concat(F.lit(name), "k").alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), F.lit(column).alias("column")) for name, kind, line, column in (("work", 12, 4, 22), ("Box", 5, 10, 13), ("box", 13, 16, 6))]
    symbols = keyed.select("file_path", F.explode(F.array(*rows)).alias("x")).select("file_path", "x.*")
    work, box = (semantic.symbol_key(F.col("file_path"), F.concat(F.lit(name), "k"), F.lit(line), F.lit(column)) for name, line, column in (("work", 5, 22), ("Box", 11, 13)))
    outgoing = keyed.select(work.alias("key"), F.concat(F.lit("src/f"), "d", F.lit(".ts")).alias("to_file"), F.concat(F.lit("save"), "d").alias("to_name"), F.lit(8).alias("to_line"), F.lit(9).alias("to_column"))
    uses = keyed.select(box.alias("key"), "file_path", F.lit(10).alias("line"))
    found = semantic.sweep(symbols, uses, outgoing)
    # A use has no name of its own: the class on its line stands for it.
    found = found.withColumn("source_uri", F.when(F.col("reference_type") == "references", F.col("target_uri")).otherwise(F.col("source_uri")))
    return semantic.resolve(found, entities(spark, sf_dir)).select("source_uri", "target_uri", "reference_type")


@query("WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), tree AS (SELECT 0::BIGINT AS id, 0 AS level UNION ALL SELECT t.id, tree.level + 1 FROM tree JOIN t ON t.parent = tree.id) SELECT id::VARCHAR AS id, level FROM tree")
def symbol_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: a third of a key is the symbol above it."""
    parts = star.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3).cast("string")).alias("parent"), F.col("p_name").alias("name"))
    return semantic.flatten_symbols(parts).select("id", "level")


@query(f"WITH {CALLS} SELECT 'incoming' AS direction, src AS other FROM named WHERE dst = 's1' UNION SELECT 'outgoing', dst FROM named WHERE src = 's1'")
def call_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.call_hierarchy(star.call_edges(spark, sf_dir), "s1")


# Files and stores.
_NATION = f"n AS (SELECT '<{KG}nation/' || n_nationkey || '>' AS s, '{terms.RDF_TYPE}' AS p, '<{KG}Nation>' AS o FROM nation UNION ALL SELECT '<{KG}nation/' || n_nationkey || '>', '<{KG}name>', '\"' || n_name || '\"' FROM nation UNION ALL SELECT '<{KG}nation/' || n_nationkey || '>', '<{KG}region>', '<{KG}region/' || n_regionkey || '>' FROM nation)"


def _through_files(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        rdf.write(star.triples(spark, sf_dir, "nation"), path, kind)
        return rdf.read(spark, path, kind).select("s", "p", "o")

    query(f"WITH {_NATION} SELECT * FROM n", f"files_{kind}")(run)


for _kind in ("nt", "turtle", "xml"):
    _through_files(_kind)


@query(f"SELECT '<{KG}doc/' || doc_id || '>' AS s, '<{KG}text>' AS p, '\"' || text || '\"' AS o FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))")
def files_long_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as literals, written and read as N-Triples."""
    docs = star.table(spark, sf_dir, "documents").where("text is not null").where(~F.contains("text", F.lit("\x00")))
    rows = docs.select(F.concat(F.lit(f"<{KG}doc/"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"), F.lit(f"<{KG}text>").alias("p"), terms.text_term(F.col("text")).alias("o"))
    path = f"{shared_dir(spark)}/literals-{uuid.uuid4().hex}"
    rdf.write(rows, path, "nt")
    return rdf.read_ntriples(spark, path)


def _drawn(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        v, e = star.suppliers(spark, sf_dir), star.call_edges(spark, sf_dir).withColumn("relationship", F.lit("calls")).withColumn("weight", F.lit("1"))
        write, read = (property_graph.graphml, property_graph.read_graphml) if kind == "graphml" else (property_graph.gexf, property_graph.read_gexf)
        property_graph.write_document(write(v, e), path)
        nodes, links = read(spark, path)
        name = F.col("attrs")["name"] if kind == "graphml" else F.col("name")
        label = F.col("attrs")["relationship"] if kind == "graphml" else F.col("relationship")
        nodes = nodes.select("id", name.alias("name"), F.col("attrs")["type"].alias("type"), F.lit(None).cast("string").alias("dst"))
        return nodes.unionByName(links.select(F.col("src").alias("id"), label.alias("name"), F.col("attrs")["weight"].alias("type"), "dst"))

    query(f"WITH {CALLS} SELECT 's' || s_suppkey AS id, s_name AS name, n_name AS type, NULL AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT src, 'calls', '1', dst FROM named", f"files_{kind}")(run)


for _kind in ("graphml", "gexf"):
    _drawn(_kind)


@query(f"WITH {_NATION} SELECT * FROM n WHERE s <> '<{KG}nation/3>' AND o <> '<{KG}nation/3>' AND NOT (s = '<{KG}nation/4>' AND p = '<{CODE}rating>') UNION ALL SELECT '<{KG}nation/4>', '<{CODE}rating>', '\"9\"^^<{terms.XSD}integer>'")
def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store changed, saved and opened again."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = Store(spark, folder)
    store.add(star.triples(spark, sf_dir, "nation"))
    store.update_entity(f"{KG}nation/4", {"rating": 9})
    store.delete_entity(f"{KG}nation/3")
    store.save()
    again = Store(spark, folder)
    again.load()
    return again.triples.select("s", "p", "o")


def upkeep(spark: SparkSession, sf_dir: str) -> dict:
    """Seconds and files rewritten of a whole build, and of an update after one file changed."""
    texts = stage(spark, sources(spark, sf_dir), "upkeep-files")
    updater = Updater(spark, f"{shared_dir(spark)}/upkeep-{uuid.uuid4().hex}", lambda wanted: texts.join(wanted.select(F.col("file_path").alias("path")), "path", "left_semi"))
    change = texts.select(F.col("path").alias("file_path"), F.lit("created").alias("event_type"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.sha2("content", 256).alias("content_hash"))
    full = updater.apply(change, 0)
    one = updater.apply(change.where("file_path = 'src/f1.ts'").withColumn("content_hash", F.lit("other")), 1)
    return {"files": full.files_processed, "full_seconds": round(full.seconds, 3), "update_seconds": round(one.seconds, 3), "files_touched": one.affected_files}


def _updated(spark: SparkSession, sf_dir: str) -> Updater:
    """All files taken in, then one changed and one deleted."""
    files_now = sources(spark, sf_dir)
    texts = {"now": files_now}

    def contents(wanted: DataFrame) -> DataFrame:
        return texts["now"].join(wanted.select(F.col("file_path").alias("path")), "path", "left_semi")

    updater = Updater(spark, f"{shared_dir(spark)}/updated-{uuid.uuid4().hex}", contents, buckets=16)
    change = files_now.select(F.col("path").alias("file_path"), F.lit("created").alias("event_type"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.sha2("content", 256).alias("content_hash"))
    updater.apply(change, 0)
    texts["now"] = files_now.withColumn("content", F.when(F.col("path") == "src/f4.ts", F.lit("export function work4() { return 4; }\n")).otherwise(F.col("content")))
    rows = [("src/f4.ts", "modified", "new"), ("src/f8.ts", "deleted", None)]
    updater.apply(spark.createDataFrame(rows, "file_path string, event_type string, content_hash string").withColumn("ts", F.lit("2024-01-02").cast("timestamp")), 1)
    return updater


@query(f"WITH {SRC}, kinds AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _KINDS.items())}) v(kind, each)) SELECT kind, (each * (SELECT count(*) - 2 FROM src) + CASE WHEN kind IN ('module', 'function') THEN 1 ELSE 0 END)::BIGINT AS n FROM kinds")
def updated_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES} SELECT src AS caller, CASE WHEN dst LIKE '%/f4.ts#%' THEN '{BASE}src/f4.ts#function_work4_1' ELSE dst END AS callee FROM edges WHERE src NOT LIKE '%/f4.ts#%' AND src NOT LIKE '%/f8.ts#%' AND dst NOT LIKE '%/f8.ts#%'")
def updated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls after the change: into the changed file they follow its new place, into the deleted one they end."""
    return sparql(_updated(spark, sf_dir).graph, "SELECT ?caller ?callee WHERE { ?caller code:calls ?callee }")


# Patterns, joins and functions of SPARQL.
@query("WITH v AS (SELECT 's' || s_suppkey AS id, s_name AS name, n_name AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey), e AS (WITH " + CALLS + " SELECT * FROM named) SELECT v.id, v.name, min(w.id) AS target FROM v JOIN e ON e.src = v.id JOIN v w ON w.id = e.dst WHERE w.name LIKE '%1' AND EXISTS (SELECT 1 FROM e f WHERE f.dst = v.id) GROUP BY v.id, v.name")
def property_pattern_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that are called and call one whose name ends in 1: constraints of the second node, and both directions."""
    v = star.suppliers(spark, sf_dir).withColumn("attrs", F.create_map(F.lit("last"), F.substring("name", -1, 1)))
    e = star.call_edges(spark, sf_dir).withColumn("relationship", F.lit("calls")).withColumn("type", F.lit("calls"))
    pattern = patterns.GraphPattern([{}, {"last": "1"}, {}], [{"relationship": "calls"}, {"source_index": 2, "target_index": 0, "relationship": "calls"}])
    return patterns.match_property_graph(v, e, pattern).select("id", "name", F.col("target_calls").alias("target"))


text_query(
    "optional_then_join",
    "SELECT ?name ?rich ?other WHERE { ?c a kg:Supplier ; kg:name ?name OPTIONAL { ?c kg:balance ?rich FILTER(?rich > 5000) } OPTIONAL { ?d a kg:Customer ; kg:balance ?rich ; kg:name ?other FILTER(?rich > 9000) } }",
    "SELECT s_name AS name, coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal END, c.c_acctbal)::VARCHAR AS rich, c.c_name AS other FROM supplier LEFT JOIN customer c ON c.c_acctbal > 9000 AND (s_acctbal <= 5000 OR c.c_acctbal = s_acctbal)",
)
text_query(
    "join_on_unbound",
    "SELECT ?a ?b ?x WHERE { { SELECT ?a ?x WHERE { ?n a kg:Nation ; kg:name ?a OPTIONAL { ?n kg:region ?r . ?r kg:name ?x FILTER(?x != \"ASIA\") } } } { SELECT ?b ?x WHERE { ?r a kg:Region ; kg:name ?b ; kg:name ?x } } }",
    "SELECT a.n_name AS a, b.r_name AS b, b.r_name AS x FROM (SELECT n_name, CASE WHEN r_name <> 'ASIA' THEN r_name END AS r FROM nation JOIN region ON n_regionkey = r_regionkey) a JOIN region b ON a.r = b.r_name OR a.r IS NULL",
)
text_query(
    "minus_on_unbound",
    "SELECT ?name ?x WHERE { ?n a kg:Nation ; kg:name ?name OPTIONAL { ?n kg:region ?x FILTER(?x != <%sregion/1>) } MINUS { ?r a kg:Region ; kg:name \"ASIA\" BIND(?r AS ?x) } }" % KG,
    f"SELECT n_name AS name, CASE WHEN n_regionkey <> 1 THEN '{KG}region/' || n_regionkey END AS x FROM nation WHERE n_regionkey = 1 OR n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
)
text_query("repeated_variable", "SELECT ?x WHERE { ?x code:calls ?y . ?y code:calls ?x }", f"WITH {CALLS} SELECT {_supplier('a.src')} AS x FROM calls a JOIN calls b ON a.dst = b.src AND a.src = b.dst")
text_query(
    "whole_graph_count",
    "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }",
    f"WITH {CALLS} SELECT ((SELECT count(*) * 2 FROM region) + (SELECT count(*) * 3 FROM nation) + (SELECT count(*) * 5 FROM customer) + (SELECT count(*) * 4 FROM supplier) + (SELECT count(*) * 6 FROM part) + (SELECT count(*) * 5 FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM calls))::VARCHAR AS n",
)
text_query(
    "aggregates_avg_sample",
    "SELECT ?brand (AVG(?size) AS ?mean) (SAMPLE(?brand) AS ?one) WHERE { ?p a kg:Part ; kg:brand ?brand ; kg:size ?size } GROUP BY ?brand HAVING (AVG(?size) > 1)",
    "SELECT p_brand AS brand, avg(p_size)::VARCHAR AS mean, p_brand AS one FROM part GROUP BY p_brand HAVING avg(p_size) > 1",
)
text_query(
    "path_negated",
    f"SELECT ?x WHERE {{ <{KG}nation/1> !(kg:name|<{terms.RDF}type>) ?x }}",
    f"SELECT '{KG}region/' || n_regionkey AS x FROM nation WHERE n_nationkey = 1",
)
text_query(
    "constructors",
    'SELECT ?r (STRDT(?name, <http://www.w3.org/2001/XMLSchema#token>) AS ?typed) (LANG(STRLANG(?name, "EN")) AS ?tag) (LANG(UCASE(STRLANG(?name, "de"))) AS ?kept) (STR(IRI(CONCAT("http://x/", ?name))) AS ?iri) (ISBLANK(BNODE()) AS ?blank) (STRLEN(STRUUID()) AS ?long) (ISIRI(UUID()) AS ?unique) WHERE { ?r a kg:Region ; kg:name ?name }',
    f"SELECT '{KG}region/' || r_regionkey AS r, r_name AS typed, 'en' AS tag, 'de' AS kept, 'http://x/' || r_name AS iri, 'true' AS blank, '36' AS long, 'true' AS \"unique\" FROM region",
)


@query(
    f"SELECT o_orderkey::VARCHAR AS key, year(o_orderdate)::VARCHAR AS y, month(o_orderdate)::VARCHAR AS m, day(o_orderdate)::VARCHAR AS d, hour(o_orderdate)::VARCHAR AS h, minute(o_orderdate)::VARCHAR AS mi, '7.25' AS s, '+02:00' AS tz, 'PT2H' AS zone FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE AS o_orderdate FROM orders)"
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as times of another zone: half past nine in UTC."""
    orders = star.table(spark, sf_dir, "orders")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T11:30:07.25+02:00"))
    rows = orders.select(F.concat(F.lit(f"<{KG}orders/"), F.col("o_orderkey").cast("string"), F.lit(">")).alias("s"), F.lit(f"<{KG}at>").alias("p"), terms.typed_term(at, "dateTime").alias("o"))
    text = "SELECT (STRAFTER(STR(?x), 'orders/') AS ?key) (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (SECONDS(?t) AS ?s) (TZ(?t) AS ?tz) (TIMEZONE(?t) AS ?zone) WHERE { ?x kg:at ?t }"
    return sparql(Graph.of(rows), text)


# Analytics, checks and changes.
_STEPS = f"{CALLS}, reach AS (SELECT DISTINCT src AS s, dst AS node, 1 AS far FROM named UNION SELECT r.s, e.dst, r.far + 1 FROM reach r JOIN named e ON e.src = r.node WHERE r.far < 25)"


@query(
    f"WITH RECURSIVE {_STEPS}, dist AS (SELECT s, node, min(far) AS far FROM reach WHERE s <> node GROUP BY 1, 2), walk AS (SELECT src AS s, dst AS node, [dst] AS path FROM named WHERE src <> dst UNION ALL SELECT w.s, e.dst, list_append(w.path, e.dst) FROM walk w JOIN named e ON e.src = w.node JOIN dist ON dist.s = w.s AND dist.node = e.dst AND dist.far = len(w.path) + 1), "
    "ways AS (SELECT s, node, count(*) AS n FROM walk GROUP BY 1, 2), inner_nodes AS (SELECT s, node, unnest(path[1:-2]) AS id FROM walk WHERE len(path) > 1), share AS (SELECT i.id, sum(1.0 / w.n) AS total FROM inner_nodes i JOIN ways w USING (s, node) GROUP BY 1), size AS (SELECT count(*) AS n FROM supplier) "
    "SELECT 's' || s_suppkey AS id, round(coalesce(total, 0) / ((n - 1) * (n - 2)), 9)::DOUBLE AS score FROM supplier CROSS JOIN size LEFT JOIN share ON share.id = 's' || s_suppkey"
)
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.betweenness(star.call_edges(spark, sf_dir), star.suppliers(spark, sf_dir))
    return found.select("id", F.round("score", 9).alias("score"))


@query(
    f"WITH RECURSIVE {CALLS}, walk AS (SELECT dst AS node, ['s1', dst] AS path FROM named WHERE src = 's1' UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN named e ON e.src = w.node WHERE len(w.path) < 4), best AS (SELECT node, min(len(path)) AS n FROM walk GROUP BY 1) SELECT w.node, (n - 1)::INTEGER AS depth, array_to_string(min(path), '>') AS path FROM walk w JOIN best USING (node) WHERE len(path) = n GROUP BY w.node, n"
)
def neighbors_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.neighbors(star.call_edges(spark, sf_dir), "s1", 3)
    return found.select("node", "depth", F.array_join("path", ">").alias("path"))


@query(f"WITH {SRC} SELECT file AS file_path, './f' || d || ',./gone' || k AS dependencies FROM src")
def module_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.module_dependencies(entities(spark, sf_dir)).select("file_path", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"WITH {SRC}, c AS (SELECT * FROM (VALUES ('Function', 4), ('Class', 1), ('Module', 1), ('Variable', 9), ('Interface', 1), ('Import', 2), ('Export', 1)) v(label, each)) SELECT label, (each * (SELECT count(*) FROM src))::BIGINT AS n FROM c")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods are functions too; properties and parameters are variables."""
    return validate.entity_counts(graph(spark, sf_dir))


@query(f"SELECT 'no type' AS issue, '<{KG}doc/' || doc_id || '>' AS subject FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT 'no name', '<{KG}doc/' || doc_id || '>' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source IS NOT NULL)")
def validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are named, labelled ones are typed."""
    found, key = Graph(spark), star.Key(f"{KG}doc/", "doc_id")
    found.register("documents", star.table(spark, sf_dir, "documents").where("source is not null"), key, {star.code("hasName"): star.Value("source", "string")})
    found.register("labels", star.table(spark, sf_dir, "labels"), key, {terms.RDF_TYPE: star.Fixed(star.code("Module"))})
    return validate.issues(found)


@query("SELECT count(*) AS n, count(DISTINCT path) AS files FROM (SELECT CASE event_type WHEN 'error' THEN 'node_modules/' WHEN 'view' THEN '.git/' ELSE 'src/' END || 'u' || user_id || CASE WHEN user_id % 2 = 0 THEN '.js' ELSE '.txt' END AS path FROM events) WHERE path LIKE 'src/%.js'")
def watched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("event_type") == "error", "node_modules/").when(F.col("event_type") == "view", ".git/").otherwise("src/")
    end = F.when(F.col("user_id") % 2 == 0, ".js").otherwise(".txt")
    rows = star.table(spark, sf_dir, "events").select(F.concat(folder, F.lit("u"), F.col("user_id").cast("string"), end).alias("file_path"))
    return changes.watched(rows).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"))


@query(f"WITH {SRC} SELECT file AS file_path, {_EACH}::BIGINT AS entities FROM src")
def file_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_file, _ = changes.file_maps(entities(spark, sf_dir))
    return by_file.select("file_path", F.size("uris").cast("long").alias("entities"))


@query("SELECT title FROM (VALUES ('Functions calling a function'), ('Functions called by a function'), ('Functions in a module'), ('Variables accessed by a function'), ('Call chain between functions'), ('Unused functions'), ('High complexity functions'), ('Functions with many parameters'), ('Find functions that perform database operations'), ('Find functions calling a function')) v(title)")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in templates.suggestions("function")], "title string")
