"""Graphs beyond the bound give what small ones give."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import analytics


def test_betweenness_of_large_graphs(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(30)} | {("n0", "n0"), ("a", "b"), ("b", "c")}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    vertices = spark.createDataFrame([(f"n{k}",) for k in range(14)] + [("a",), ("b",), ("c",), ("alone",)], "id string")
    small = {r["id"]: r["score"] for r in analytics.betweenness(edges, vertices).collect()}
    large = {r["id"]: r["score"] for r in analytics.betweenness(edges, vertices, limit=10).collect()}
    assert large == pytest.approx(small) and large["b"] == pytest.approx(1 / (17 * 16)) and len(large) == 18


def test_betweenness_by_blocks_of_sources(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "src string, dst string")
    shares = analytics.dependencies_loop(edges, edges.select("src"), pairs=5)
    assert {r["id"]: r["share"] for r in shares.where(F.col("share") > 0).collect()} == {"c": 2.0}


def test_pagerank_by_joins(spark, monkeypatch):
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)], "src string, dst string")
    vertices = spark.createDataFrame([(f"n{k}",) for k in range(13)], "id string")
    small = {r["id"]: r["score"] for r in analytics.pagerank(edges, vertices, iterations=4, tolerance=0.0).collect()}
    monkeypatch.setattr(analytics.paths, "SMALL", 1)
    large = {r["id"]: r["score"] for r in analytics.pagerank(edges, vertices, iterations=4, tolerance=0.0).collect()}
    assert large == pytest.approx(small) and sum(large.values()) == pytest.approx(1)


def _ring_and_more(seed):
    rng = random.Random(seed)
    return sorted({(f"n{k}", f"n{(k + 1) % 70}") for k in range(70)} | {(f"m{rng.randrange(40)}", f"m{rng.randrange(40)}") for _ in range(50)} | {("m1", "n1"), ("m2", "m2")})


def _closed(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


def test_walks_are_dealt_over_tasks(spark):
    """few sources ask for much work, so their bytes don't decide in how many tasks they are walked."""
    edges = spark.createDataFrame(_ring_and_more(1), "src string, dst string")
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    for found in (analytics.betweenness(edges, vertices), analytics.paths.closure(edges)):
        assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    # What tasks yield of betweenness are sums, not a row for each source and node.
    shares = analytics.paths.walked(vertices.select(F.col("id").alias("src")), analytics.paths.coded(edges), "id string, share double", analytics._dependencies)
    assert shares.count() <= vertices.count() * analytics.paths.tasks(spark)


def test_closure_by_joins_moves_words_not_pairs(spark, monkeypatch):
    """rounds write 64 nodes of a source in one row."""
    pairs, written, stage = _ring_and_more(2), [], analytics.paths.stage

    def counted(*args):
        written.append((out := stage(*args)).count())
        return out

    monkeypatch.setattr(analytics.paths, "stage", counted)
    found = [tuple(r) for r in analytics.paths.closure_loop(spark.createDataFrame(pairs, "src string, dst string")).collect()]
    assert len(found) == len(set(found)) and set(found) == _closed(pairs) and max(written) < len(found) / 4
    assert analytics.paths.closure_loop(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("small", [200_000, 1])
def test_paths_between_known_ends_make_no_other_pairs(spark, monkeypatch, small):
    """a path whose ends both are known is asked only for their pairs."""
    from lattica.graph import Graph
    from lattica.plans.compiler import sparql

    pairs, made, closure = _ring_and_more(3), [], analytics.paths.closure

    def kept(*args, **more):
        made.append(closure(*args, **more))
        return made[-1]

    monkeypatch.setattr(analytics.paths, "SMALL", small)
    monkeypatch.setattr(analytics.paths, "closure", kept)
    triples = spark.createDataFrame([(f"<http://x/{a}>", "<http://x/p>", f"<http://x/{b}>") for a, b in pairs], "s string, p string, o string")
    found = sparql(Graph.of(triples), "SELECT ?a ?b WHERE { ?a <http://x/p> ?b . ?b <http://x/p>+ ?a }")
    closed = _closed(pairs)
    want = {(a, b) for a, b in pairs if (b, a) in closed}
    assert sorted((r[0].rsplit("/")[-1], r[1].rsplit("/")[-1]) for r in found.collect()) == sorted(want)
    assert made[0].count() == len(want)


@pytest.mark.parametrize(("arcs", "rounds"), [(4_000_000, False), (0, True)])
def test_closure_of_broadcast_arcs_writes_no_rounds(spark, monkeypatch, arcs, rounds):
    """arcs that may be broadcast are joined until nothing new is found in one job; more are joined in written rounds."""
    pairs = [(a, b) for a, b in _ring_and_more(4) if a[0] == "m" or int(a[1:]) < 6] + [("alone", "alone")]
    written, stage = [], analytics.paths.stage
    monkeypatch.setattr(analytics.paths, "ARCS", arcs)
    monkeypatch.setattr(analytics.paths, "stage", lambda *args: written.append(args[2]) or stage(*args))
    edges, closed = spark.createDataFrame(pairs, "src string, dst string"), _closed(pairs)
    found = [tuple(r) for r in analytics.paths.closure_loop(edges).collect()]
    assert len(found) == len(set(found)) and set(found) == closed
    assert (len(written) > 4) == rounds
    asked = [(a, b) for a, _ in pairs for b, _ in pairs]
    among = [tuple(r) for r in analytics.paths.closure_loop(edges, spark.createDataFrame(asked, "src string, dst string")).collect()]
    assert len(among) == len(set(among)) and set(among) == closed & set(asked)


def test_walks_keep_their_tasks(spark):
    """where tasks are as many as shuffle partitions, Spark joined the few rows of all walks into one."""
    edges = spark.createDataFrame(_ring_and_more(5), "src string, dst string")
    found = analytics.paths.walked(edges.select("src"), analytics.paths.coded(edges), "src string, dst string", analytics.paths._all_reached)
    assert found.rdd.getNumPartitions() == analytics.paths.tasks(spark)


def test_call_graph_over_blocks_of_lines(spark, tmp_path):
    """lines meet in blocks with one exchange, and nothing is sorted for the most frequent."""
    import duckdb

    from lattica import queries, star

    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.choice([rng.randrange(-3, 6), rng.randrange(12, 20), rng.randrange(29, 36), 2147483646, 2147483647, -2147483648]), rng.choice([rng.randrange(8), 1 << 40])) for _ in range(3000)]
    rows += [(None, 1, 2), (1, None, 2), (1, 2, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    # The SQL of the call graph adds to line numbers as they are; wider ones don't overflow.
    sql = f"WITH lineitem AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey FROM '{tmp_path}/lineitem.parquet/*.parquet'), {queries.CALLS} SELECT src, dst FROM calls"
    found = star.calls(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.connect().execute(sql).fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Generate" not in plan
