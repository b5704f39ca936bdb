"""Changes of a triple table or a property graph; every one returns a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.functions.terms import CODE


def merge(triples: DataFrame, more: DataFrame) -> DataFrame:
    """The union as a set."""
    return triples.select("s", "p", "o").unionByName(more.select("s", "p", "o")).distinct()


def _objects(value: object) -> list[str]:
    """Terms of a value; items of a list that begin with http are IRIs; None is no value."""
    if value is None:
        return []
    if isinstance(value, (list, tuple)):
        return [terms.iri(v) if isinstance(v, str) and v.startswith("http") else terms.literal(v) for v in value]
    return [terms.literal(value)]


def update(triples: DataFrame, uri: str, values: dict[str, object]) -> DataFrame:
    """Replace all values of these properties of one entity; None only removes them."""
    spark = triples.sparkSession
    subject = terms.iri(uri)
    predicates = [f"<{CODE}{name}>" for name in values]
    kept = triples.where(~((F.col("s") == F.lit(subject)) & F.col("p").isin(predicates)))
    rows = [(subject, f"<{CODE}{name}>", o) for name, value in values.items() for o in _objects(value)]
    return merge(kept, spark.createDataFrame(rows, "s string, p string, o string")) if rows else kept


def update_many(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the values of every (s, p) in ``changes`` (s, p, o) by those given there."""
    return merge(triples.join(changes.select("s", "p").distinct(), ["s", "p"], "left_anti"), changes)


def delete(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """Without the triples that have one of the entities (uri) as subject or object.

    Blank nodes that only such a triple led to go too.
    """
    gone = uris.select(terms.iri_term(F.col("uri")).alias("s")).distinct()
    owned = triples.join(gone, "s", "left_semi").where("o like '\\_:%'").select(F.col("o").alias("b")).distinct()
    rest = triples.join(gone, "s", "left_anti").join(gone.withColumnRenamed("s", "o"), "o", "left_anti")
    shared = rest.select(F.col("o").alias("b")).distinct()
    lost = owned.join(shared, "b", "left_anti").withColumnRenamed("b", "s")
    return rest.join(lost, "s", "left_anti").select("s", "p", "o")


def update_vertex(vertices: DataFrame, vertex: str, attrs: dict[str, str]) -> DataFrame:
    more = F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv])
    merged = F.map_concat(F.map_filter(F.col("attrs"), lambda k, v: ~k.isin(list(attrs))), more)
    return vertices.withColumn("attrs", F.when(F.col("id") == F.lit(vertex), merged).otherwise(F.col("attrs")))


def delete_vertex(vertices: DataFrame, edges: DataFrame, vertex: str) -> tuple[DataFrame, DataFrame]:
    """Without the vertex and the edges that touch it."""
    return vertices.where(F.col("id") != F.lit(vertex)), edges.where((F.col("src") != F.lit(vertex)) & (F.col("dst") != F.lit(vertex)))
