"""Rules of the graph engine that queries with SQL don't show."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import staging, terms
from lattica.graph import Graph
from lattica.operators import lowering, semantic
from lattica.operators.extract import extract
from lattica.plans import patterns
from lattica.plans.compiler import sparql
from lattica.sources import rdf
from lattica.streaming.updater import Updater

KG = "http://kg.local/"


def graph(spark, rows):
    return Graph.of(spark.createDataFrame([(f"<{KG}{s}>", f"<{KG}{p}>", o if o[0] in '"<' else f"<{KG}{o}>") for s, p, o in rows], "s string, p string, o string"))


def test_joins_on_unbound_variables_have_keys(spark):
    """No pairs of rows are looked at, whatever may be unbound."""
    found = graph(spark, [("a", "name", '"1"'), ("b", "name", '"2"'), ("b", "tag", '"x"'), ("c", "tag", '"x"'), ("d", "tag", '"y"'), ("d", "name", '"3"')])
    text = "SELECT ?n ?t ?o WHERE { ?s kg:name ?n OPTIONAL { ?s kg:tag ?t } OPTIONAL { ?o kg:tag ?t FILTER(?o != ?s) } MINUS { ?m kg:tag ?t FILTER(?t = \"y\") } }"
    answer = sparql(found, text)
    rows = sorted((r["n"], r["t"], r["o"]) for r in answer.collect())
    # The first has no tag: it takes any, but not the one that is taken away.
    assert rows == [("1", "x", KG + "b"), ("1", "x", KG + "c"), ("2", "x", KG + "c")]
    plan = answer._jdf.queryExecution().optimizedPlan().toString()
    keyed = "SELECT ?a ?b ?t WHERE { { SELECT ?a ?t WHERE { ?a kg:name ?n OPTIONAL { ?a kg:tag ?t } } } { SELECT ?b ?t WHERE { ?b kg:tag ?t } } FILTER(BOUND(?t)) }"
    assert "OR" not in [line for line in plan.splitlines() if "Join" in line][0].upper().split()
    assert len(sparql(found, keyed).collect()) == 3 + 2 + 1


def test_date_parts_and_languages(spark):
    found = graph(spark, [("a", "at", f'"2024-03-01T10:20:30.5-05:30"^^<{terms.XSD}dateTime>'), ("b", "at", f'"2024-03-01T10:20:30Z"^^<{terms.XSD}dateTime>'), ("c", "at", f'"2024-03-01T10:20:30"^^<{terms.XSD}dateTime>')])
    rows = {r["x"][-1]: (r["s"], r["z"], r["t"]) for r in sparql(found, "SELECT ?x (SECONDS(?t0) AS ?s) (TIMEZONE(?t0) AS ?z) (TZ(?t0) AS ?t) WHERE { ?x kg:at ?t0 }").collect()}
    assert rows == {"a": ("30.5", "-PT5H30M", "-05:30"), "b": ("30", "PT0S", "Z"), "c": ("30", None, "")}
    tagged = graph(spark, [("a", "name", '"Haus und Hof"@de')])
    row = sparql(tagged, 'SELECT (LANG(SUBSTR(?n, 1, 4)) AS ?a) (LANG(LCASE(?n)) AS ?b) (LANG(STRBEFORE(?n, " ")) AS ?c) (LANG(STRAFTER(?n, "zz")) AS ?d) (LANG(REPLACE(?n, "H", "h")) AS ?e) (STR(STRAFTER(?n, "und ")) AS ?f) WHERE { ?x kg:name ?n }').first()
    assert tuple(row) == ("de", "de", "de", "", "de", "Hof")


def test_nearest_against_all_pairs(spark):
    rng = random.Random(2)
    entities = [(rng.randrange(4), rng.randrange(60), k, f"e{k}") for k in range(150)]
    wanted = [(k, rng.randrange(5), rng.randrange(60)) for k in range(200)]
    known = spark.createDataFrame(entities, "name int, line_number int, ordinal int, uri string")
    asked = spark.createDataFrame(wanted, "id int, name int, line_number int")
    got = {r["id"]: r["uri"] for r in semantic.nearest(asked, known, ["name"]).collect()}
    want = {}
    for k, name, line in wanted:
        own = [(abs(at - line), tie, uri) for other, at, tie, uri in entities if other == name]
        if own:
            want[k] = min(own)[2]
    assert got == want and len(want) < 200


def test_symbol_trees_of_any_depth(spark):
    rows = [(str(k), str(k - 1) if k else None, f"n{k}") for k in range(15)] + [("x", "y", "a"), ("y", "x", "b")]
    tree = spark.createDataFrame(rows, "id string, parent string, name string")
    assert {r["id"]: r["level"] for r in semantic.flatten_symbols(tree).collect()} == {str(k): k for k in range(15)}
    assert semantic.flatten_symbols(tree, depth=3).count() == 4


def test_every_node_of_a_pattern_counts(spark):
    vertices = spark.createDataFrame([("a", "A", "T", {"k": "1"}), ("b", "B", "U", {"k": "2"}), ("c", "C", "U", {"k": "3"}), ("d", "D", "V", {})], "id string, name string, type string, attrs map<string,string>")
    edges = spark.createDataFrame([("a", "b", "calls", "x"), ("a", "c", "calls", "x"), ("c", "d", "uses", "x")], "src string, dst string, relationship string, type string")

    def found(nodes, links):
        return [(r["id"], *[r[c] for c in r.asDict() if c.startswith("target_")]) for r in patterns.match_property_graph(vertices, edges, patterns.GraphPattern(nodes, links)).collect()]

    call, use = {"relationship": "calls"}, {"source_index": 1, "target_index": 2, "relationship": "uses"}
    assert found([{"type": "T"}, {"type": "U", "name": "zzz"}], [call]) == []
    assert found([{"type": "T"}, {"type": "U"}], [call]) == [("a", "b")]
    assert found([{"type": "T"}, {"k": "3"}], [call]) == [("a", "c")]
    assert found([{}, {"type": "U"}, {"name": "D"}], [call, use]) == [("a", "c")]
    assert found([{"name": "C"}, {"name": "A"}], [{"source_index": 1, "target_index": 0, "relationship": "calls"}]) == [("c", "a")]
    with pytest.raises(ValueError):
        found([{}, {}, {}], [call, use, {"source_index": 2, "target_index": 0, "relationship": "calls"}])


def test_ntriples_of_any_length(spark, tmp_path):
    long = "x" * 50_000 + '\\"' * 20_000
    lines = [f'<a:s> <a:p> "{long}" .', "# a comment", "", "<a:s> <a:p> broken", '<a:s> <a:p> "end"@en .']
    path = tmp_path / "a.nt"
    path.write_text("\n".join(lines))
    found = {r["o"] for r in rdf.read_ntriples(spark, str(path)).collect()}
    assert found == {'"' + long.replace('\\"', '"') + '"', '"end"@en'}
    assert [r["value"] for r in rdf.unread_ntriples(spark, str(path)).collect()] == ["<a:s> <a:p> broken"]


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session())


def test_small_means_few_bytes_too(spark):
    rows = spark.createDataFrame([("x" * 1000, "y")] * 10, "src string, dst string")
    assert staging.at_most(rows, 10) and not staging.at_most(rows, 9) and not staging.at_most(rows, 10, size=5000)
    assert staging.at_most(rows.limit(0), 0)


def test_updates_touch_few_files_and_equal_a_rebuild(spark, tmp_path):
    """Of fifty files one changes: what is rewritten, and that the graph is as if built anew."""
    texts = {f"file_{k}.js": f"export function one_{k}() {{ return two_{k}(); }}\nexport function two_{k}() {{ return {k}; }}\n" for k in range(50)}
    texts["file_1.js"] = "import { one_0 } from './file_0';\nclass B extends A {}\nexport function one_1() { return one_0(); }\n"
    texts["file_2.js"] = "export class A { go() { return 1; } }\n"

    def contents(wanted):
        return spark.createDataFrame(list(texts.items()), "file_path string, content string").join(wanted, "file_path").select(F.col("file_path").alias("path"), "content")

    def batch(names, kind, at):
        return spark.createDataFrame([(n, kind, f"2024-01-0{at} 00:00:00", None if kind == "deleted" else str(hash(texts[n]))) for n in names], "file_path string, event_type string, ts string, content_hash string").withColumn("ts", F.col("ts").cast("timestamp"))

    def rebuilt():
        files = spark.createDataFrame(list(texts.items()), "path string, content string")
        return set(map(tuple, lowering.lower(extract(files)).collect()))

    updater = Updater(spark, str(tmp_path / "graph"), contents)
    assert updater.apply(batch(texts, "created", 1), 0).files_processed == 50
    everything = spark.read.parquet(f"{tmp_path}/graph/version=0/triples").count()
    texts["file_0.js"] = "export function one_0() { return 0; }\n"
    result = updater.apply(batch(["file_0.js"], "modified", 2), 1)
    assert (result.files_processed, result.affected_files) == (1, 2)
    rewritten = {r[0] for t in ("entities", "triples") for r in spark.read.parquet(f"{tmp_path}/graph/version=1/{t}").select("file_path").distinct().collect()}
    assert len(rewritten) <= 50 / 10 and spark.read.parquet(f"{tmp_path}/graph/version=1/triples").count() < everything / 10
    assert set(map(tuple, updater.graph.scan().select("s", "p", "o").collect())) == rebuilt()
    del texts["file_2.js"]
    result = updater.apply(batch(["file_2.js"], "deleted", 3), 2)
    assert result.files_deleted == 1 and result.affected_files == 2
    assert set(map(tuple, updater.graph.scan().select("s", "p", "o").collect())) == rebuilt()
