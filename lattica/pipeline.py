"""From a folder of source files to a queryable graph, and its incremental upkeep."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.engine import QueryEngine, QueryResult
from lattica.functions.staging import stage
from lattica.graph import Graph
from lattica.operators import extract, lowering, semantic, spans, validate
from lattica.sources import files as sources
from lattica.streaming import changes as feed


@dataclass
class KnowledgeGraph:
    entities: DataFrame
    triples: DataFrame
    #: Lowered triples with the file each belongs to: (file_path, s, p, o).
    owned: DataFrame | None = None
    statistics: dict = field(default_factory=dict)

    @property
    def graph(self) -> Graph:
        return Graph.of(self.triples)

    def query(self, text: str) -> QueryResult:
        return QueryEngine(self.graph).sparql(text)

    def context(self, uri: str, depth: int = 2) -> QueryResult:
        return QueryEngine(self.graph).context(uri, depth)

    def issues(self) -> DataFrame:
        return validate.issues(self.graph)


def from_files(spark: SparkSession, found: DataFrame, references: DataFrame | None = None, with_spans: bool = True) -> KnowledgeGraph:
    """A graph from files (path, content): extraction, semantic merge, lowering, spans."""
    began = time.perf_counter()
    entities = stage(spark, extract.extract(found), "entities")
    if references is not None:
        extra = semantic.resolve(references, entities).where("reference_type = 'calls'")
        more = extra.select(F.concat(F.lit("<"), "source_uri", F.lit(">")).alias("s"), F.lit(lowering.code("calls")).alias("p"), F.concat(F.lit("<"), "target_uri", F.lit(">")).alias("o"))
    owned = stage(spark, lowering.lower_by_file(entities), "owned")
    triples = owned.select("s", "p", "o")
    if references is not None:
        triples = triples.unionByName(more)
    if with_spans:
        texts = found.select("path", sources.text(F.col("content")).alias("text"))
        triples = triples.unionByName(spans.span_triples(spans.spans(entities, texts), texts))
    triples = stage(spark, triples.distinct(), "triples")
    counts = {r["kind"]: r["count"] for r in entities.groupBy("kind").count().collect()}
    stats = {"files": counts.get("module", 0), "entities": sum(counts.values()), "by_kind": counts, "triples": triples.count(), "seconds": time.perf_counter() - began}
    return KnowledgeGraph(entities, triples, owned, stats)


def process(spark: SparkSession, folder: str, references: DataFrame | None = None) -> KnowledgeGraph:
    """A graph from the source files below a folder; a folder without any is an error."""
    found = sources.read(spark, folder)
    if found.isEmpty():
        raise ValueError(f"no source files below {folder}")
    found = found.withColumn("path", F.regexp_replace("path", "^" + folder.rstrip("/").replace(".", "\\.") + "/", ""))
    return from_files(spark, found, references)


def update(spark: SparkSession, kg: KnowledgeGraph, changes: DataFrame, contents: DataFrame) -> KnowledgeGraph:
    """The graph after changes (file_path, event_type): changed files are extracted anew, the rest stays.

    Triples are lowered again for the changed files and for those whose
    relations lead to them; spans are made by :func:`from_files` alone.
    """
    wanted = contents.join(changes.where("event_type <> 'deleted'").select(F.col("file_path").alias("path")), "path", "left_semi")
    new = extract.extract(wanted)
    entities = stage(spark, feed.upsert(kg.entities, changes, new), "entities")
    files = stage(spark, lowering.touched(entities.unionByName(kg.entities), changes), "touched")
    owned = kg.owned if kg.owned is not None else lowering.lower_by_file(kg.entities)
    kept = owned.join(files, "file_path", "left_anti").select("file_path", "s", "p", "o")
    owned = stage(spark, kept.unionByName(lowering.relower(entities, files)), "owned")
    triples = owned.select("s", "p", "o").distinct()
    return KnowledgeGraph(entities, triples, owned, kg.statistics | {"entities": entities.count(), "triples": triples.count()})
