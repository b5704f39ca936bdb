"""Semantic references: cross-file marks, nearest definitions, merging into entities.

A language server is outside the engine; its output comes in as two tables:
references (source_uri, target_uri, reference_type, file_path, line_number,
context) and definitions (key, file_path, name, line_number, uri).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.staging import stage


def symbol_key(file: Column, name: Column, line: Column, column: Column) -> Column:
    return F.concat_ws("|", F.lit("KEY"), file, name, F.concat_ws(":", line.cast("string"), column.cast("string")))


def path_of_uri(uri: Column) -> Column:
    """The path of a file URI."""
    return F.url_decode(F.regexp_replace(uri, "^file://", ""))


def flatten_symbols(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, parent, name, level) of a symbol tree (id, parent, name) from its roots down, by levels.

    Each level is written and the next one met from it, until one is empty or
    ``depth`` is reached.
    """
    spark = symbols.sparkSession
    level = stage(spark, symbols.where("parent is null").select("id", "parent", "name").withColumn("level", F.lit(0)), "symbols")
    out = [level]
    while (depth is None or len(out) <= depth) and not level.isEmpty():
        level = symbols.join(level.select(F.col("id").alias("parent")), "parent").select("id", "parent", "name").withColumn("level", F.lit(len(out)))
        level = stage(spark, level, "symbols")
        out.append(level)
    return reduce(DataFrame.unionByName, out)


#: A server's numbers for kinds of symbols that are definitions here.
SYMBOL_KINDS = {5: "class", 6: "method", 11: "interface", 12: "function"}


def definitions(symbols: DataFrame) -> DataFrame:
    """(key, kind, file_path, name, line_number, column_number) of a server's symbols.

    ``symbols`` has file_path, name, kind (the server's number), line and column
    counted from 0; other kinds than those of ``SYMBOL_KINDS`` are left out.
    """
    names = F.create_map(*[x for k, v in SYMBOL_KINDS.items() for x in (F.lit(k), F.lit(v))])
    line = (F.col("line") + 1).cast("int")
    known = symbols.where(F.col("kind").isin(list(SYMBOL_KINDS)))
    key = symbol_key(F.col("file_path"), F.col("name"), line, F.col("column"))
    return known.select(key.alias("key"), names[F.col("kind")].alias("kind"), "file_path", "name", line.alias("line_number"), F.col("column").cast("int").alias("column_number")).distinct()


def sweep(symbols: DataFrame, uses: DataFrame, outgoing: DataFrame) -> DataFrame:
    """References (source_uri, target_uri, reference_type, file_path, line_number, context) from a server's answers.

    ``uses`` (key, file_path, line) are the places where a definition is named,
    ``outgoing`` (key, to_file, to_name, to_line, to_column) the calls that
    leave it.  Answers for what is no definition are left out; a use's source is
    the place itself.
    """
    known = definitions(symbols).select("key", F.col("file_path").alias("own_file"), F.col("line_number").alias("own_line"))
    line = (F.col("line") + 1).cast("int")
    named = uses.join(known, "key").select(symbol_key(F.col("file_path"), F.lit(""), line, F.lit(0)).alias("source_uri"), F.col("key").alias("target_uri"), F.lit("references").alias("reference_type"), "file_path", line.alias("line_number"), F.lit("").alias("context"))
    target = symbol_key(F.col("to_file"), F.col("to_name"), (F.col("to_line") + 1).cast("int"), F.col("to_column"))
    called = outgoing.join(known, "key").select(F.col("key").alias("source_uri"), target.alias("target_uri"), F.lit("calls").alias("reference_type"), F.col("own_file").alias("file_path"), F.col("own_line").alias("line_number"), F.lit("").alias("context"))
    return named.unionByName(called).distinct()


def cross_file(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References whose target is defined in another file."""
    known = definitions.select(F.col("key").alias("target_uri"), F.col("file_path").alias("defined_in"))
    return references.join(known, "target_uri").where(F.col("defined_in") != F.col("file_path"))


def references_to(references: DataFrame, target: str) -> DataFrame:
    return references.where(F.col("target_uri") == F.lit(target))


def references_from(references: DataFrame, source: str) -> DataFrame:
    return references.where(F.col("source_uri") == F.lit(source))


def nearest(wanted: DataFrame, entities: DataFrame, by: list[str], line: str = "line_number", tie: str = "ordinal", value: str = "uri") -> DataFrame:
    """For each row of ``wanted`` (an ``id`` with ``by`` and ``line``) the entity of the same ``by`` at the nearest line.

    The first of equally near ones wins.  The last entity up to a row and the
    first one after it are found in one ordered pass, so no pairs are made;
    rows without any are left out.
    """
    spot = entities.groupBy(*by, F.col(line).alias("at")).agg(F.min(F.struct(F.col(tie).alias("tie"), F.col(value).alias("value"))).alias("one"))
    spot = spot.select(*by, "at", F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), F.lit(0).alias("asks"), F.struct("at", "one.tie", "one.value").alias("here"))
    asked = wanted.select(*by, F.col(line).alias("at"), "id", F.lit(1).alias("asks"), F.lit(None).cast(spot.schema["here"].dataType).alias("here"))
    order = Window.partitionBy(*by).orderBy("at", "asks")
    before = F.last("here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("here", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = spot.unionByName(asked).select("id", "asks", "at", F.array(before, after).alias("found")).where("asks = 1")
    ranked = F.array_min(F.transform(F.filter("found", lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x["at"] - F.col("at")).alias("far"), x["tie"].alias("tie"), x["value"].alias("value"))))
    return both.select("id", ranked["value"].alias(value)).where(F.col(value).isNotNull())


def resolve(references: DataFrame, entities: DataFrame) -> DataFrame:
    """References with both ends as entity URIs: as they stand, or the nearest entity of that file and name.

    A reference with an end that no entity answers to is left out.
    """
    known = entities.select(F.col("uri")).distinct()
    out = references
    for end in ("source_uri", "target_uri"):
        exact = out.join(known.withColumnRenamed("uri", end), end, "left_semi")
        rest = out.join(known.withColumnRenamed("uri", end), end, "left_anti")
        # Where an end leads depends on its text alone, so each text is looked up once.
        asked = rest.select(F.col(end).alias("id")).distinct()
        key = F.split("id", r"\|")
        asked = asked.select("id", key[1].alias("file_path"), key[2].alias("name"), F.split(key[3], ":")[0].cast("int").alias("line_number"))
        found = nearest(asked, entities, ["file_path", "name"]).withColumnRenamed("id", end)
        out = exact.select(*references.columns).unionByName(rest.join(found, end).drop(end).withColumnRenamed("uri", end).select(*references.columns))
    return out


def merge(entities: DataFrame, references: DataFrame) -> DataFrame:
    """Entities with ``calls`` and ``called_by`` URIs from resolved references, each once and in order."""
    calls = resolve(references, entities).where("reference_type = 'calls'").select("source_uri", "target_uri")
    out = calls.groupBy(F.col("source_uri").alias("uri")).agg(F.array_sort(F.collect_set("target_uri")).alias("calls_uris"))
    into = calls.groupBy(F.col("target_uri").alias("uri")).agg(F.array_sort(F.collect_set("source_uri")).alias("called_by_uris"))
    return entities.join(out, "uri", "left").join(into, "uri", "left")


def definition(entities: DataFrame, uri: str) -> DataFrame:
    """Where an entity is defined: (uri, file_path, line_number, column_number)."""
    return entities.where(F.col("uri") == F.lit(uri)).select("uri", "file_path", "line_number", "column_number")


def type_information(entities: DataFrame, uri: str) -> DataFrame:
    """What is written about an entity's type: its own type name and those of its parameters."""
    kinds = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type_name"].alias("type_name")))
    return entities.where(F.col("uri") == F.lit(uri)).select("uri", "kind", "type_name", kinds.alias("parameters"))


def call_hierarchy(edges: DataFrame, uri: str) -> DataFrame:
    """(direction, other): who calls this entity and whom it calls."""
    into = edges.where(F.col("dst") == F.lit(uri)).select(F.lit("incoming").alias("direction"), F.col("src").alias("other"))
    out = edges.where(F.col("src") == F.lit(uri)).select(F.lit("outgoing").alias("direction"), F.col("dst").alias("other"))
    return into.union(out).distinct()


def declared_before_use(lines: DataFrame) -> DataFrame:
    """(file, name, declared, used) of uses at or after a declaration, from lines (file, line, text).

    A declaration is ``const``, ``let`` or ``var``; a use is the name as a word.
    """
    declared = lines.select("file", F.col("line").alias("declared"), F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))).alias("name"))
    words = lines.select("file", F.col("line").alias("used"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name"))
    first = declared.groupBy("file", "name").agg(F.min("declared").alias("declared"))
    return words.join(first, ["file", "name"]).where(F.col("used") >= F.col("declared")).select("file", "name", "declared", "used")


def line_imports(lines: DataFrame) -> DataFrame:
    """(file, line, module_path) of import statements, line by line."""
    path = F.regexp_extract("text", r"""^\s*import\b.*?['"]([^'"]+)['"]""", 1)
    return lines.select("file", "line", path.alias("module_path")).where("module_path <> ''")


def line_calls(lines: DataFrame, stop: tuple[str, ...] = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "new")) -> DataFrame:
    """(file, line, callee) of calls, line by line."""
    each = lines.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1))).alias("callee"))
    return each.where(~F.col("callee").isin(list(stop)))
