"""Graph analytics over vertices (id, type, ...) and edges (src, dst, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.staging import at_most, ship, stage
from lattica.operators import paths

#: Sources of a block times nodes of a large graph: the most rows that the levels of a block have in all.
PAIRS = 200_000_000


def nodes_by_type(vertices: DataFrame, kind: str) -> DataFrame:
    return vertices.where(F.col("type") == F.lit(kind))


def out_neighbors(edges: DataFrame, vertex: str) -> DataFrame:
    """(node, edges): each out-neighbour with the edges that lead there."""
    own = edges.where(F.col("src") == F.lit(vertex))
    columns = [c for c in edges.columns if c not in ("src", "dst")]
    return own.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(F.struct(*columns) if columns else F.lit(1))).alias("edges"))


def strong_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component) with the smallest id of the strongly connected component.

    A small graph is walked once on a worker.  A large one is taken apart by
    forward and backward colouring: every node takes the largest name that
    reaches it, and the nodes that reach their colour's own node along edges
    of one colour are its component; the rest goes round again.
    """
    spark = edges.sparkSession
    edges = stage(spark, edges.select("src", "dst").distinct(), "scc-edges")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    nodes = (nodes if vertices is None else nodes.union(vertices.select("id"))).distinct()
    if at_most(edges, paths.SMALL) and at_most(nodes, paths.SMALL):
        ship(spark)
        both = edges.union(nodes.select("id", F.lit(None).cast("string")))
        return both.coalesce(1).mapInPandas(_tarjan, "id string, component string")
    done: list[DataFrame] = []
    left_nodes, left = stage(spark, nodes, "scc-nodes"), stage(spark, edges, "scc-edges")
    while not left_nodes.isEmpty():
        colours = spread(spark, left, left_nodes.select("id", F.col("id").alias("colour")))
        inner = left.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        back = stage(spark, inner, "scc-inner")
        members = stage(spark, colours.where("id = colour").select("id", "colour"), "scc-seeds")
        newest = members
        while not newest.isEmpty():
            reached = newest.select(F.col("id").alias("dst"), "colour").join(back, ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            newest = stage(spark, reached.join(members, ["id", "colour"], "left_anti"), "scc-new")
            members = stage(spark, members.union(newest), "scc-members")
        least = members.groupBy("colour").agg(F.min("id").alias("component"))
        done.append(stage(spark, members.join(least, "colour").select("id", "component"), "scc-done"))
        gone = done[-1].select("id")
        left_nodes = stage(spark, left_nodes.join(gone, "id", "left_anti"), "scc-nodes")
        left = stage(spark, left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "scc-edges")
    return reduce(DataFrame.unionByName, done) if done else nodes.select("id", F.col("id").alias("component"))


def spread(spark, edges: DataFrame, colours: DataFrame) -> DataFrame:
    """The largest colour that reaches each node along the edges."""
    colours = stage(spark, colours, "scc-colours")
    while True:
        sent = edges.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("sent"))
        new = colours.join(sent, "id", "left").select("id", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.coalesce("sent", "colour") > F.col("colour")).alias("moved"))
        new = stage(spark, new, "scc-colours")
        colours = new.select("id", "colour")
        if new.where("moved").isEmpty():
            return colours


def _tarjan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components of one small graph; a row without a target is a node."""
    graph: dict[str, list[str]] = {}
    for frame in frames:
        for src, dst in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
            own = graph.setdefault(src, [])
            if dst is not None and dst == dst:
                own.append(dst)
                graph.setdefault(dst, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[tuple[str, str]] = []
    for root in sorted(graph):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(graph[root]))]
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(graph[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on.discard(members[-1])
                        if members[-1] == node:
                            break
                    out += [(m, min(members)) for m in members]
    if out:
        yield pd.DataFrame(out, columns=["id", "component"])


def components_report(components: DataFrame) -> DataFrame:
    """(component_id, nodes, size) of components."""
    return components.groupBy(F.col("component").alias("component_id")).agg(F.array_sort(F.collect_list("id")).alias("nodes"), F.count(F.lit(1)).alias("size"))


def degree_centrality(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, score): in- and out-edges, parallel ones counted, by the other nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    scored = vertices.select("id").join(ends, "id", "left").crossJoin(F.broadcast(n))  # one row
    return scored.select("id", F.when(F.col("n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("score"))


def pagerank(edges: DataFrame, vertices: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score) by power iteration; a node without out-edges gives to all alike, parallel edges weigh each.

    Iteration stops when the total change falls below ``tolerance`` for each
    node.  A small edge set is iterated in one task on arrays; a large one by
    joins and aggregates with one written round at a time.
    """
    spark = edges.sparkSession
    edges = stage(spark, edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), "pagerank-edges")
    if at_most(edges, paths.SMALL) and at_most(vertices, paths.SMALL):
        ship(spark)
        both = vertices.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")).union(edges)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(frames), ignore_index=True)
            names = np.array(sorted(set(rows["src"]) | set(rows["dst"].dropna())))
            if not len(names):
                return
            real = rows[rows["dst"].notna()]
            src, dst = np.searchsorted(names, real["src"]), np.searchsorted(names, real["dst"])
            weight = real["weight"].to_numpy()
            yield pd.DataFrame({"id": names, "score": _iterate(len(names), src, dst, weight, alpha, iterations, tolerance)})

        return both.coalesce(1).mapInPandas(run, "id string, score double")
    n = vertices.count()
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = stage(spark, edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "pagerank-shares")
    sinks = stage(spark, vertices.select("id").join(total.select(F.col("src").alias("id")), "id", "left_anti"), "pagerank-sinks")
    ranks = stage(spark, vertices.select("id", F.lit(1.0 / max(n, 1)).alias("score")), "pagerank")
    for _ in range(iterations):
        loose = ranks.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        base = alpha * loose / n + (1 - alpha) / n
        sent = shares.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("sent"))
        new = ranks.join(sent, "id", "left").select("id", (F.coalesce("sent", F.lit(0.0)) * alpha + base).alias("score"), F.col("score").alias("old"))
        new = stage(spark, new, "pagerank")
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        ranks = new.select("id", "score")
        if change is None or change < n * tolerance:
            break
    return ranks


def _iterate(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, alpha: float, iterations: int, tolerance: float) -> np.ndarray:
    total = np.bincount(src, weights=weight, minlength=n)
    share = weight / total[src]
    rank = np.full(n, 1.0 / n)
    for _ in range(iterations):
        new = alpha * (np.bincount(dst, weights=rank[src] * share, minlength=n) + rank[total == 0].sum() / n) + (1 - alpha) / n
        done = np.abs(new - rank).sum() < n * tolerance
        rank = new
        if done:
            break
    return rank


def betweenness(edges: DataFrame, vertices: DataFrame, limit: int = paths.SMALL) -> DataFrame:
    """(id, score): shortest paths through each node, by (n - 1)(n - 2) pairs.

    Of a graph of at most ``limit`` edges, sources are dealt over the workers,
    each with the whole edge set.  A larger one is walked level by level, from
    a block of sources at once, by joins with written rounds.
    """
    edges = stage(edges.sparkSession, edges.select("src", "dst").distinct(), "betweenness-edges")
    sources = vertices.select(F.col("id").alias("src"))
    if at_most(edges, limit):
        shares = paths.walked(sources, paths.coded(edges), "id string, share double", _dependencies)
    else:
        shares = dependencies_loop(edges, sources)
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    total = vertices.select("id").join(shares.groupBy("id").agg(F.sum("share").alias("share")), "id", "left").crossJoin(F.broadcast(n))  # one row
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return total.select("id", F.when(F.col("n") > 2, F.coalesce("share", F.lit(0.0)) / pairs).otherwise(F.lit(0.0)).alias("score"))


def dependencies_loop(edges: DataFrame, sources: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(id, share): what :func:`_dependencies` yields for each block of sources, summed by node.

    The levels of a block are written going out, with the number of shortest
    paths from each source, and read again going back.
    """
    spark = edges.sparkSession
    sources = stage(spark, sources.distinct().join(edges.select("src"), "src", "left_semi"), "betweenness-sources")
    nodes = edges.select("src").union(edges.select("dst")).distinct().count()
    blocks = -(-sources.count() * nodes // pairs)
    done = [spark.createDataFrame([], "id string, share double")]
    for block in range(blocks):
        own = sources.where(F.pmod(F.xxhash64("src"), F.lit(blocks)) == block)
        levels = [stage(spark, own.select(F.col("src").alias("source"), F.col("src").alias("node"), F.lit(1.0).alias("count")), "betweenness-level")]
        while not levels[-1].isEmpty():
            known = reduce(DataFrame.union, levels).select("source", "node")
            reached = levels[-1].join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("count").alias("count"))
            levels.append(stage(spark, reached.join(known, ["source", "node"], "left_anti"), "betweenness-level"))
        # The last level is empty, the first holds the sources themselves.
        below = levels[-1].withColumn("share", F.lit(0.0))
        for level in reversed(levels[1:-1]):
            passed = below.select("source", F.col("node").alias("dst"), ((F.col("share") + 1) / F.col("count")).alias("each"))
            passed = passed.join(edges, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum("each").alias("each"))
            share = F.coalesce(F.col("count") * F.col("each"), F.lit(0.0)).alias("share")
            below = stage(spark, level.join(passed, ["source", "node"], "left").select("source", "node", "count", share), "betweenness-shares")
            done.append(below.groupBy(F.col("node").alias("id")).agg(F.sum("share").alias("share")))
        done[1:] = [stage(spark, reduce(DataFrame.union, done).groupBy("id").agg(F.sum("share").alias("share")), "betweenness-sums")]
    return reduce(DataFrame.union, done)


def _dependencies(names: list[str], after: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every node passes on of the shortest paths from the sources of one task."""
    number, total = {name: k for k, name in enumerate(names)}, [0.0] * len(names)
    for batch in batches:
        for source in batch.column(0).to_pylist():
            if source in number:
                _pass_on(after, number[source], total)
    some = [k for k, share in enumerate(total) if share]
    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.string()), pa.array([total[k] for k in some], pa.float64())], names=["id", "share"])


def _pass_on(after: list[list[int]], source: int, total: list[float]) -> None:
    """Adds what every node passes on of the shortest paths from ``source``."""
    level, seen = {source: 1.0}, {source}
    levels: list[dict[int, float]] = []
    while level:
        # Paths to each node of the next level.
        further: dict[int, float] = {}
        for node, count in level.items():
            for nxt in after[node]:
                if nxt not in seen:
                    further[nxt] = further.get(nxt, 0.0) + count
        seen.update(further)
        levels.append(further)
        level = further
    each: dict[int, float] = {}
    for level in reversed(levels):
        passed: dict[int, float] = {}
        for node, count in level.items():
            share = 0.0
            for nxt in after[node]:
                if nxt in each:
                    share += each[nxt]
            share *= count
            total[node] += share
            passed[node] = (1 + share) / count
        each = passed


def centrality(edges: DataFrame, vertices: DataFrame, kind: str = "betweenness") -> DataFrame:
    """(id, score) from the highest; an unknown kind is degree centrality."""
    found = {"betweenness": betweenness, "pagerank": pagerank}.get(kind, degree_centrality)(edges, vertices)
    return found.orderBy(F.desc("score"), "id")


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, score): the share of directed triangles among those possible at each node.

    Edges are taken once and without loops; links in both directions count.
    Each link goes from its end of lower degree to the other, so a hub does
    not pair all its neighbours.
    """
    arcs = stage(edges.sparkSession, edges.where("src <> dst").select("src", "dst").distinct(), "clustering-edges")
    both = arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    degree = both.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.sum("w").alias("arcs"), F.sum(F.when(F.col("w") == 2, 1).otherwise(0)).alias("mutual"))
    ranked = both.join(degree.select(F.col("id").alias("a"), F.col("links").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("links").alias("db")), "b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    out = ranked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("lo"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("hi"), "w")
    first, second = out.select("lo", F.col("hi").alias("x"), F.col("w").alias("w1")), out.select("lo", F.col("hi").alias("y"), F.col("w").alias("w2"))
    wedges = first.join(second, "lo").where("x < y")
    closing = both.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("w3"))
    triangles = wedges.join(closing, ["x", "y"]).select(F.explode(F.array("lo", "x", "y")).alias("id"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    t = triangles.groupBy("id").agg(F.sum("t").alias("t"))
    possible = F.col("arcs") * (F.col("arcs") - 1) - 2 * F.col("mutual")
    joined = vertices.select("id").join(degree, "id", "left").join(t, "id", "left")
    return joined.select("id", F.when(possible > 0, F.coalesce("t", F.lit(0.0)) / possible).otherwise(F.lit(0.0)).alias("score"))


def statistics(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: nodes, edges, is_directed, density, average clustering."""
    n = vertices.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = clustering(edges, vertices).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("clustering"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0))
    return n.crossJoin(m).crossJoin(c).select("nodes", "edges", F.lit(True).alias("is_directed"), density.alias("density"), "clustering")  # single rows


def type_counts(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
