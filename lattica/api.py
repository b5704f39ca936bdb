"""Constructors of the engine's parts by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.engine import QueryEngine
from lattica.graph import Graph
from lattica.pipeline import KnowledgeGraph, process
from lattica.sources.store import PropertyStore, Store

BACKENDS = {"triples": Store, "property": PropertyStore}


def create_store(spark: SparkSession, folder: str, backend: str = "triples") -> Store | PropertyStore:
    """A store by the name of its backend; an unknown name is an error."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[backend](spark, folder)


def create_engine(source: Graph | Store | KnowledgeGraph | DataFrame, **options) -> QueryEngine:
    """A query engine over a graph, a store, a built graph or a table of triples."""
    if isinstance(source, DataFrame):
        source = Graph.of(source)
    return QueryEngine(source if isinstance(source, Graph) else source.graph, **options)


def build(spark: SparkSession, folder: str, references: DataFrame | None = None) -> KnowledgeGraph:
    """The graph of the source files below a folder."""
    return process(spark, folder, references)
