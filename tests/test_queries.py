"""Every registered graph query against its SQL."""

import math

import duckdb
import pytest

from lattica import code_queries
from lattica.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def lowered_once():
    """The generated code is extracted and lowered once for all queries over it."""
    made, patch = {}, pytest.MonkeyPatch()

    def once(name, own):
        def call(spark, sf_dir):
            if name not in made:
                made[name] = own(spark, sf_dir)
            return made[name]

        return call

    for name in ("entities", "graph"):
        patch.setattr(code_queries, name, once(name, getattr(code_queries, name)))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in columns]
    want = sorted("|".join(plain(r[k]) for k in order) for r in cur.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_betweenness_against_enumeration(spark, data):
    """Shortest paths counted by brute force."""
    from collections import defaultdict, deque

    from lattica import star

    rows = {r["id"]: r["score"] for r in QUERIES["betweenness"](spark, data).collect()}
    graph = defaultdict(set)
    for src, dst in star.call_edges(spark, data).collect():
        graph[src].add(dst)
    total = defaultdict(float)

    def shortest(a, b):
        found, queue, least = [], deque([[a]]), None
        while queue:
            path = queue.popleft()
            if least is not None and len(path) > least:
                break
            if path[-1] == b and len(path) > 1:
                least = len(path)
                found.append(path)
                continue
            queue.extend([*path, n] for n in sorted(graph[path[-1]]) if n not in path)
        return found

    for a in rows:
        for b in rows:
            if a != b and (ways := shortest(a, b)):
                for path in ways:
                    for node in path[1:-1]:
                        total[node] += 1 / len(ways)
    n = len(rows)
    for node, score in rows.items():
        assert abs(score - total[node] / ((n - 1) * (n - 2))) < 1e-6
