"""Checks and statistics of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.terms import CODE, RDF_TYPE
from lattica.graph import Graph
from lattica.model import KINDS


def design_patterns(entities: DataFrame) -> DataFrame:
    """(uri, name, pattern) of classes and functions named like a design pattern."""
    low = F.lower("name")
    pattern = F.when(low.contains("singleton"), "singleton").when(low.contains("factory") | low.contains("create"), "factory")
    return entities.select("uri", "name", pattern.alias("pattern")).where("pattern is not null")


def module_dependencies(entities: DataFrame) -> DataFrame:
    """(file_path, dependencies) from imports."""
    imports = entities.where("kind = 'import'")
    return imports.groupBy("file_path").agg(F.array_sort(F.collect_set("module_path")).alias("dependencies"))


def public_api(entities: DataFrame) -> DataFrame:
    return entities.where("is_exported").select("uri", "name", "kind", "file_path")


def orphans(graph: Graph) -> DataFrame:
    """Subjects that have a name and no type."""
    named = graph.scan(p=f"<{CODE}hasName>").select("s").distinct()
    return named.join(graph.scan(p=RDF_TYPE).select("s"), "s", "left_anti")


def nameless(graph: Graph) -> DataFrame:
    """Entities of a known class without a name."""
    classes = [f"<{CODE}{c}>" for c in KINDS.values()]
    typed = graph.scan(p=RDF_TYPE).where(F.col("o").isin(classes)).select("s").distinct()
    return typed.join(graph.scan(p=f"<{CODE}hasName>").select("s"), "s", "left_anti")


def entity_counts(graph: Graph, classes: tuple[str, ...] = ("Function", "Class", "Module", "Variable", "Interface", "Import", "Export")) -> DataFrame:
    """(label, n) of these classes, zero included."""
    wanted = graph.spark.createDataFrame([(c,) for c in classes], "label string")
    found = graph.scan(p=RDF_TYPE).select(F.regexp_extract("o", r"([^/#]*)>$", 1).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sparse(vertices: DataFrame, edges: DataFrame, least: float = 0.5) -> bool:
    """Whether there are fewer than ``least`` edges for each node."""
    n = vertices.count()
    return bool(n) and edges.count() < least * n


def issues(graph: Graph) -> DataFrame:
    """(issue, subject) of all checks."""
    return orphans(graph).select(F.lit("no type").alias("issue"), F.col("s").alias("subject")).union(nameless(graph).select(F.lit("no name"), "s"))
