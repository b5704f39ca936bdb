"""The query engine: SPARQL text, templates, patterns, sentences and context over a graph."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import terms
from lattica.functions.staging import stage
from lattica.functions.terms import CODE
from lattica.graph import Graph
from lattica.plans import compiler, parser, patterns, templates


@dataclass
class QueryResult:
    """A lazy answer; rows are counted or fetched only when asked for."""

    df: DataFrame | None
    kind: str
    query: str
    seconds: float = 0.0
    context: dict = field(default_factory=dict)
    success: bool = True
    error: str = ""

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.df.collect()] if self.df is not None else []

    def count(self) -> int:
        return self.df.count() if self.df is not None else 0


class QueryEngine:
    def __init__(self, graph: Graph, cache_size: int = 100, compat_falsy_null: bool = False):
        self.graph = graph
        self.cache_size = cache_size
        self.compat_falsy_null = compat_falsy_null
        self._cache: OrderedDict[tuple[int, str], QueryResult] = OrderedDict()

    def sparql(self, query: str, use_cache: bool = True) -> QueryResult:
        """Compile a query; one that can't be read gives ``success=False`` and is not kept.

        Kept plans belong to the graph's version, so a change is never hidden.
        """
        key = (self.graph.version, query)
        if use_cache and key in self._cache:
            return self._cache[key]
        began = time.perf_counter()
        try:
            df = compiler.sparql(self.graph, query)
        except parser.QueryError as e:
            return QueryResult(None, "sparql", query, time.perf_counter() - began, success=False, error=str(e))
        if self.compat_falsy_null:
            df = df.select(*[F.when(~F.col(c).isin("false", "0", ""), F.col(c)).alias(c) for c in df.columns])
        result = QueryResult(df, "sparql", query, time.perf_counter() - began)
        if use_cache:
            while len(self._cache) >= self.cache_size:
                self._cache.popitem(last=False)
            self._cache[key] = result
        return result

    def template(self, name: str, **values: object) -> QueryResult:
        if name not in templates.TEMPLATES:
            raise ValueError(f"unknown template {name!r}")
        result = self.sparql(templates.TEMPLATES[name].fill(**values))
        return QueryResult(result.df, "template", result.query, result.seconds, {"template": name}, result.success, result.error)

    def ask_sentence(self, sentence: str) -> QueryResult:
        """Answer a sentence by the first pattern that matches; none gives an empty answer."""
        found = templates.dispatch(sentence)
        if not found:
            return QueryResult(None, "natural", sentence, context={"matched_template": None})
        result = self.sparql(found[1], use_cache=False)
        return QueryResult(result.df, "natural", found[1], result.seconds, {"matched_template": found[0]}, result.success, result.error)

    def match(self, pattern: patterns.GraphPattern) -> QueryResult:
        began = time.perf_counter()
        return QueryResult(patterns.match(self.graph, pattern), "pattern", repr(pattern), time.perf_counter() - began)

    def context(self, uri: str, depth: int = 2, relationships: list[str] | None = None) -> QueryResult:
        """Triples around an entity, in both directions, up to ``depth`` hops.

        ``relationships`` keeps predicates of these local names.  Each row has
        direction, hop, the triple's parts and the label of its far end.
        """
        spark, rows = self.graph.spark, self.graph.scan()
        if relationships:
            rows = rows.where(F.col("p").isin([f"<{CODE}{r}>" for r in relationships]))
        frontier = spark.createDataFrame([(terms.iri(uri),)], "node string")
        seen, out = frontier, []
        for hop in range(1, depth + 1):
            forth = rows.join(frontier.withColumnRenamed("node", "s"), "s").select(F.lit("outgoing").alias("direction"), "s", "p", "o", F.col("o").alias("node"))
            back = rows.join(frontier.withColumnRenamed("node", "o"), "o").select(F.lit("incoming").alias("direction"), "s", "p", "o", F.col("s").alias("node"))
            found = stage(spark, forth.unionByName(back).withColumn("hop", F.lit(hop)), "context")
            out.append(found)
            frontier = found.where("node not like '\"%'").select("node").distinct().join(seen, "node", "left_anti")
            seen = seen.union(frontier)
        every = reduce(DataFrame.unionByName, out)
        first = every.groupBy("direction", "s", "p", "o", "node").agg(F.min("hop").alias("hop"))
        names = self.graph.scan(p=f"<{CODE}hasName>").groupBy(F.col("s").alias("node")).agg(F.min(terms.lexical(F.col("o"))).alias("label"))
        df = first.join(names, "node", "left").select("direction", "hop", *[terms.lexical(F.col(c)).alias(c) for c in ("s", "p", "o")], "label")
        return QueryResult(df, "context", uri, context={"uri": uri, "depth": depth})

    def explain(self, query: str) -> dict:
        """A rough complexity by variables, hints, and Spark's plan."""
        marks = query.count("?")
        hints = []
        if "+" in query or "*" in query.replace("SELECT *", "").replace("(*)", ""):
            hints.append("a transitive path walks the graph; a constant end keeps the walk small")
        if "REGEX" in query.upper():
            hints.append("a regular expression reads every value; STRSTARTS or = may do")
        df = compiler.sparql(self.graph, query)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return {"complexity": "high" if marks > 10 else "medium" if marks > 5 else "low", "variables": marks, "hints": hints, "plan": plan}

    def benchmark(self, queries: list[str], iterations: int = 3) -> dict[str, dict]:
        """Seconds of each query (average, least, most) and the rows of its last run."""
        out = {}
        for query in queries:
            times, rows = [], 0
            for _ in range(iterations):
                began = time.perf_counter()
                rows = compiler.sparql(self.graph, query).count()
                times.append(time.perf_counter() - began)
            name = query if len(query) <= 50 else query[:50] + "..."
            out[name] = {"avg": sum(times) / len(times), "min": min(times), "max": max(times), "rows": rows}
        return out

    @staticmethod
    def suggestions(partial: str) -> list[str]:
        return templates.suggestions(partial)
