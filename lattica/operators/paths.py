"""Paths over edges (src, dst): closure, breadth-first levels, simple paths.

An edge set of at most ``SMALL`` rows and 20 MB, checked by a bounded count, is sent to
all workers and every source is walked where its row lies, in one job.  Beyond
that nodes are numbered and what is newest is joined with the arcs until nothing
new is found: where it lies with up to ``ARCS`` of them broadcast, else by
shuffles, one written round at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.staging import at_most, ship, stage

#: Edges that may be sent to every worker, of 20 MB of names at most.
SMALL = 200_000

#: Arcs between numbered nodes that may be sent to every worker, 12 bytes each at most and 16 for a node.
ARCS = 4_000_000

#: The word that holds the bit of node b, and that bit.
_WORD, _BIT = "shiftright(b, 6) AS word", "shiftleft(1L, cast(b & 63 as int)) AS bit"


def coded(edges: DataFrame) -> tuple[list[str], list[list[int]]]:
    """Names in order and each one's successors by number, of an edge set whose size has been checked."""
    rows = edges.collect()
    names = sorted({name for row in rows for name in row})
    number = {name: k for k, name in enumerate(names)}
    after: list[set[int]] = [set() for _ in names]
    for src, dst in rows:
        after[number[src]].add(number[dst])
    return names, [sorted(found) for found in after]


def tasks(spark: SparkSession) -> int:
    """How many tasks share walks: few rows that ask for much work, so their bytes must not decide."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def walked(rows: DataFrame, graph: tuple[list[str], list[list[int]]], schema: str, walk: Callable[[list, list, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows that ``walk(names, after, batches)`` yields; the graph is broadcast, equal sources lie together."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(graph)
    # Dealt before they are made distinct: Spark leaves out a repartition that follows an exchange on the same key, and joins the parts of that one.
    dealt = rows.repartition(tasks(spark), "src").distinct().sortWithinPartitions("src")
    return dealt.mapInArrow(lambda batches: walk(*shared.value, batches), schema)


def reached(after: list[list[int]], source: int) -> set[int]:
    """The nodes reachable in one hop or more; the source itself only by a cycle."""
    seen: set[int] = set()
    frontier = {source}
    while frontier:
        frontier = {n for node in frontier for n in after[node]} - seen
        seen |= frontier
    return seen


def _all_reached(names: list[str], after: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of each source and all that it reaches, some 65,000 rows at a time."""
    texts, number = pa.array(names, pa.string()), {name: k for k, name in enumerate(names)}

    def rows(held: list[tuple[int, set[int]]]) -> pa.RecordBatch:
        src = np.repeat(np.array([k for k, _ in held], np.int64), [len(found) for _, found in held])
        dst = np.concatenate([np.fromiter(found, np.int64, len(found)) for _, found in held])
        return pa.RecordBatch.from_arrays([texts.take(pa.array(src)), texts.take(pa.array(dst))], names=["src", "dst"])

    held, size = [], 0
    for batch in batches:
        for source in batch.column(0).to_pylist():
            if (k := number.get(source)) is not None and (found := reached(after, k)):
                held.append((k, found))
                size += len(found)
            if size >= 1 << 16:
                yield rows(held)
                held, size = [], 0
    if held:
        yield rows(held)


def _asked_reached(names: list[str], after: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (src, dst), in order of src, whose first end reaches the second."""
    number = {name: k for k, name in enumerate(names)}
    last, found = None, set()
    for batch in batches:
        keep = []
        for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if src != last:
                last, found = src, reached(after, number[src]) if src in number else set()
            keep.append(number.get(dst) in found)
        yield batch.filter(pa.array(keep, pa.bool_()))


def closure(edges: DataFrame, start: str | None = None, end: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all pairs joined by one edge or more.

    A given end starts the walk there, so no other pairs are made; of pairs
    ``among`` which the answer is asked, only those that are joined come out.
    """
    if start is None and end is not None:
        swapped = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start=end)
        return swapped.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    spark = edges.sparkSession
    # Written once: the edges may be the end of a long plan, and are read several times.
    edges = stage(spark, edges.select("src", "dst").distinct(), "closure-edges")
    sources = edges.select("src") if start is None else spark.createDataFrame([(start,)], "src string")
    if at_most(edges, SMALL):
        graph = coded(edges)
        out = walked(sources, graph, "src string, dst string", _all_reached) if among is None else walked(among.select("src", "dst"), graph, "src string, dst string", _asked_reached)
    elif start is None:
        return closure_loop(edges, among)
    else:
        out = closure_from(edges, start)
    return out if end is None else out.where(F.col("dst") == F.lit(end))


def closure_from(edges: DataFrame, start: str) -> DataFrame:
    """The closure of one source by joins: the newest pairs extended by one edge, without those known."""
    spark = edges.sparkSession
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("further"))
    parts = [stage(spark, edges.where(F.col("src") == F.lit(start)), "closure-new")]
    while not parts[-1].isEmpty():
        known = reduce(DataFrame.union, parts)
        new = parts[-1].join(step, "dst").select("src", F.col("further").alias("dst")).distinct()
        parts.append(stage(spark, new.join(known, ["src", "dst"], "left_anti"), "closure-new"))
    return reduce(DataFrame.union, parts)


def _words_before(ids: np.ndarray, prior: np.ndarray, start: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, word, bits) of all that reach the nodes of each word: their bits pass back over the arcs until nothing new comes.

    ids are the nodes in order; prior[start[k]:start[k + 1]] are those before node k.
    """
    bits, got = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
    for batch in batches:
        for word in batch.column(0).to_pylist():
            near = np.arange(*np.searchsorted(ids >> 6, [word, word + 1]))
            fresh, seen = np.uint64(1) << (ids[near] & 63).astype(np.uint64), [near[:0]]
            while near.size:
                size = start[near + 1] - start[near]
                to = prior[np.repeat(start[near] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                np.bitwise_or.at(got, to, np.repeat(fresh, size))
                near = np.unique(to) if 8 * len(to) < len(ids) else np.flatnonzero(got)
                fresh, got[near] = got[near] & ~bits[near], 0
                near, fresh = near[fresh != 0], fresh[fresh != 0]
                seen.append(near[bits[near] == 0])
                bits[near] |= fresh
            found = np.concatenate(seen)
            yield from pa.table({"a": ids[found], "word": np.full(len(found), word), "bits": bits[found].view(np.int64)}).to_batches(1 << 16)
            bits[found] = 0


def _words_walked(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(a, word, bits) of the closure: arcs are broadcast as arrays, and joined where a word lies until nothing new comes."""
    pairs = arcs.toArrow()
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    ids = np.unique(np.concatenate([a, b]))
    b = np.searchsorted(ids, b)
    prior = np.searchsorted(ids, a).astype(np.int32)[np.argsort(b)]
    start = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=len(ids)))]).astype(np.int64)
    found = walked(nodes.select(F.shiftright("id", 6).alias("src")), (ids, prior, start), "a long, word long, bits long", _words_before)
    # Written, as Spark takes what Python yields to be as small as what it read, and would broadcast it.
    return stage(arcs.sparkSession, found, "closure-known")


def _words_joined(arcs: DataFrame) -> DataFrame:
    """(a, word, bits) of the closure by shuffled joins: the newest bits pass to the nodes before, one written round at a time."""
    spark = arcs.sparkSession
    newest = stage(spark, arcs.selectExpr("a", _WORD, _BIT).groupBy("a", "word").agg(F.bit_or("bit").alias("bits")), "closure-new")
    known, before, none = newest, arcs.select(F.col("a").alias("prior"), F.col("b").alias("a")), F.lit(0).cast("long")
    while not newest.isEmpty():
        sent = newest.join(before, "a").select(F.col("prior").alias("a"), "word", none.alias("bits"), F.col("bits").alias("sent"))
        both = known.select("a", "word", "bits", none.alias("sent")).union(sent).groupBy("a", "word").agg(F.bit_or("bits").alias("old"), F.bit_or("sent").alias("come"))
        known = stage(spark, both.select("a", "word", F.expr("old | come").alias("bits"), F.expr("come & ~old").alias("fresh")), "closure-known")
        newest = known.where("fresh <> 0").select("a", "word", F.col("fresh").alias("bits"))
    return known.select("a", "word", "bits")


def closure_loop(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The closure by joins, or those of the pairs ``among`` that it holds.

    Nodes have numbers, and a row is a source with 64 neighbouring numbers as
    the bits of one word.  Arcs of numbers, at most ``ARCS``, are broadcast and
    joined until nothing new is found; more are joined in written rounds.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().orderBy(F.length("name"), "name")
    # Numbers of one partition follow each other, and begin with a whole word.
    nodes = stage(spark, nodes.select("name", F.monotonically_increasing_id().alias("id")), "closure-nodes")
    arcs = edges.join(nodes.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(nodes.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst")
    arcs = stage(spark, arcs.select("a", "b").distinct(), "closure-arcs")
    found = _words_walked(nodes, arcs) if at_most(arcs, ARCS) else _words_joined(arcs)
    first = nodes.select(F.col("id").alias("a"), F.col("name").alias("src"))
    if among is not None:
        last = nodes.select(F.col("id").alias("b"), F.col("name").alias("dst"))
        asked = among.select("src", "dst").distinct().join(first, "src").join(last, "dst").selectExpr("src", "dst", "a", _WORD, _BIT)
        return asked.join(found, ["a", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("src", "dst")
    # Members come last, so that no exchange moves a word's names with each of its rows; these are few bytes that make many pairs.
    members = nodes.withColumnRenamed("id", "b").selectExpr("name", _WORD, _BIT).groupBy("word").agg(F.collect_list(F.struct("bit", "name")).alias("members"))
    pairs = found.join(first, "a").select("src", "word", "bits").repartition(tasks(spark), "src", "word").join(members, "word").select("src", "bits", F.explode("members").alias("m"))
    return pairs.where(F.col("bits").bitwiseAND(F.col("m.bit")) != 0).select("src", F.col("m.name").alias("dst"))


def neighbors(edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """(node, depth, path) within ``depth`` hops along the edges.

    depth is the first hop that reaches the node, path a shortest one: the
    smallest, by node names in order.  The start is found again over a cycle.
    """
    spark = edges.sparkSession
    edges = stage(spark, edges.select("src", "dst").distinct(), "neighbors-edges")
    frontier = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    found: list[DataFrame] = []
    for hop in range(1, depth + 1):
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        reached = reached.groupBy("node").agg(F.min("path").alias("path"))
        for earlier in found:
            reached = reached.join(earlier.select("node"), "node", "left_anti")
        frontier = stage(spark, reached, "neighbors") if hop < depth else reached
        found.append(frontier.withColumn("depth", F.lit(hop)))
    return reduce(DataFrame.unionByName, [f.select("node", "depth", "path") for f in found])


def simple_paths(edges: DataFrame, start: str, end: str | None = None, cutoff: int = 10) -> DataFrame:
    """(path, length) of the paths without a repeated node, of at most ``cutoff`` edges."""
    spark = edges.sparkSession
    edges = stage(spark, edges.select("src", "dst").distinct(), "paths-edges")
    paths = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    found: list[DataFrame] = []
    for _ in range(cutoff):
        paths = paths.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = stage(spark, paths.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "paths")
        if paths.isEmpty():
            break
        found.append(paths if end is None else paths.where(F.col("node") == F.lit(end)))
        if end is not None:
            paths = paths.where(F.col("node") != F.lit(end))
    if not found:
        return spark.createDataFrame([], "path array<string>, length int")
    return reduce(DataFrame.unionByName, found).select("path", (F.size("path") - 1).alias("length"))
