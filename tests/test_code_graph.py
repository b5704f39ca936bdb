"""Source files to a graph: extraction, lowering, storage, upkeep."""

import pathlib

import pytest
from pyspark.sql import functions as F

from lattica import pipeline
from lattica.functions.terms import CODE
from lattica.model import entity_class, entity_uri, range_text
from lattica.operators import analytics, crud, extract, lowering, paths, semantic, spans
from lattica.sources import property_graph, rdf
from lattica.sources.store import Store

FILES = {
    "src/utils.js": "export function formatString(s) { return s.trim(); }\nexport function validateEmail(e) { return e; }\n",
    "src/main.js": "import { formatString, validateEmail } from './utils';\nimport './other';\nfunction processUserInput(input) { return formatString(input) + validateUser(input); }\nfunction validateUser(u) { return validateEmail(u); }\n",
    "src/other.js": "import { x } from './main';\nexport class Animal { constructor(n) { this.n = n; } speak() { return 1; } }\nclass Dog extends Animal { speak() { return query(); } }\nfunction query() { return 2; }",
    "node_modules/x/a.js": "function no() {}",
    "src/a.test.js": "function no() {}",
    ".hidden/b.js": "function no() {}",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, text in FILES.items():
        path = pathlib.Path(root, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def kg(spark, folder):
    return pipeline.process(spark, folder)


def rows(result):
    return sorted(tuple(r.values()) for r in result.rows())


def test_identities():
    assert entity_uri("a/b.js", "function", "x$y", 3) == "http://codebase.local/a/b.js#function_x_y_3"
    assert entity_uri("a/b.js", "module", "b", 1) == "http://codebase.local/a/b.js#module"
    assert range_text(1, 2, 3, 4) == "1:2-3:4" and range_text(1, 2) == "1:2"
    with pytest.raises(ValueError):
        entity_class("nothing")


def test_extract_one_file():
    text = "/** Adds. */\nexport async function add(a, { b } = {}, ...rest) {\n  // not(a call)\n  return sum(a, 'x(y)');\n}\nconst f = (x) => add(x);\nclass A extends B implements C {\n  static #n = 1;\n  get v() { return this.#n; }\n}\n"
    found = {(r["kind"], r["name"]): r for r in extract.extract_file("m.ts", text)}
    add = found["function", "add"]
    assert add["is_async"] and add["is_exported"] and add["docstring"] == "Adds." and add["line_number"] == 2
    assert [(p["name"], p["is_rest"], p["is_optional"]) for p in add["parameters"]] == [("a", False, False), ("b", False, True), ("rest", True, False)]
    assert add["calls"] == ["sum"]
    assert found["function", "f"]["is_arrow_function"] and found["function", "f"]["calls"] == ["add"]
    assert found["class", "A"]["extends_class"] == "B" and found["class", "A"]["implements"] == ["C"]
    assert found["property", "#n"]["is_static"] and found["property", "#n"]["is_private"]
    assert found["method", "v"]["is_getter"]


@pytest.mark.parametrize("text", ["", "}", "function (", "class X {", "import from ''", "'", "`${", "a(b(c", "é" * 50 + "\nfunction ü() {}"])
def test_extract_of_broken_text(text):
    assert extract.extract_file("x.js", text)[0]["kind"] == "module"


def test_only_source_files_are_read(kg):
    assert kg.statistics["files"] == 3


def test_calls_within_and_across_files(kg):
    found = rows(kg.query("SELECT ?a ?b WHERE { ?f code:calls ?g . ?f code:hasName ?a . ?g code:hasName ?b }"))
    assert found == [("processUserInput", "formatString"), ("processUserInput", "validateUser"), ("speak", "query"), ("validateUser", "validateEmail")]


def test_inheritance_members_and_cycles(kg):
    assert rows(kg.query("SELECT ?a ?b WHERE { ?c code:extends ?d . ?c code:hasName ?a . ?d code:hasName ?b }")) == [("Dog", "Animal")]
    assert rows(kg.query("SELECT ?n (COUNT(?m) AS ?k) WHERE { ?c a code:Class ; code:hasName ?n ; code:hasMethod ?m } GROUP BY ?n")) == [("Animal", "2"), ("Dog", "1")]
    assert len(rows(kg.query("SELECT ?a ?b WHERE { ?a code:imports ?b . ?b code:imports+ ?a }"))) == 2


def test_spans_hold_the_text(kg):
    assert rows(kg.query('SELECT ?b ?t WHERE { ?f a code:Function ; code:hasName "formatString" ; code:hasSourceSpan ?s . ?s code:byteStart ?b ; code:previewText ?t }')) == [("16", "formatString(s) { return s.trim(); }")]


def test_byte_offsets(spark):
    df = spark.createDataFrame([("é\nab\n",)], "t string")
    at = [df.select(spans.byte_offset(F.col("t"), F.lit(line), F.lit(column))).first()[0] for line, column in ((1, 0), (1, 1), (2, 1), (9, 9))]
    assert at == [0, 2, 4, 6]


@pytest.mark.parametrize(("path", "want"), [("a/b.js", (True, True, True)), ("a/node_modules/b.js", (False, True, False)), ("a/coverage/b.ts", (False, True, True)), ("a/b.min.js", (True, False, True)), ("a/B.MIN.js", (True, False, True)), ("__tests__/b.js", (True, False, True)), ("a/.x/b.js", (False, True, False)), ("a/b.mjs", (True, True, False)), ("a/b.JS", (False, True, False)), (".b.js", (False, True, False))])
def test_file_filters(spark, path, want):
    from lattica.sources import files

    df = spark.createDataFrame([(path, 10)], "path string, length long")
    row = df.select(files.discovered(F.col("path")), files.included(F.col("path"), F.col("length")), files.for_server(F.col("path"))).first()
    assert tuple(row) == want


def test_definition_and_types(spark, kg):
    uri = kg.entities.where("name = 'formatString' and kind = 'function'").select("uri").first()[0]
    assert semantic.definition(kg.entities, uri).first()["line_number"] == 1
    assert [p["name"] for p in semantic.type_information(kg.entities, uri).first()["parameters"]] == ["s"]
    calls = extract.resolved_calls(kg.entities)
    assert [r["direction"] for r in semantic.call_hierarchy(calls, uri).collect()] == ["incoming"]


def test_nothing_is_wrong(kg):
    assert kg.issues().collect() == []


@pytest.mark.parametrize("kind", ["parquet", "nt", "turtle", "xml"])
def test_snapshots(spark, kg, tmp_path, kind):
    store = Store(spark, str(tmp_path))
    store.add(kg.triples)
    store.add(kg.triples.limit(5))
    target = store.save(kind)
    assert store.metadata()["triples_count"] == kg.triples.count() and store.latest() == target
    again = Store(spark, str(tmp_path))
    assert again.load()
    named = "s not like '\\_:%' and o not like '\\_:%'"
    assert again.triples.where(named).exceptAll(kg.triples).count() == 0
    assert again.triples.count() == kg.triples.count()
    assert again.statistics()["backup_count"] == 1


def test_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert not store.load() and store.statistics()["triples"] == 0
    with pytest.raises(ValueError):
        store.save("pickle")


def test_update_and_delete(spark, kg):
    uri = kg.entities.where("name = 'validateUser' and kind = 'function'").select("uri").first()[0]
    changed = crud.update(kg.triples, uri, {"rating": [1, "http://x/y"], "hasScope": None})
    own = {(r["p"].strip("<>").removeprefix(CODE), r["o"]) for r in changed.where(F.col("s") == f"<{uri}>").collect()}
    assert ("rating", "<http://x/y>") in own and not any(p == "hasScope" for p, _ in own)
    rest = crud.delete(kg.triples, spark.createDataFrame([(uri,)], "uri string"))
    assert rest.where((F.col("s") == f"<{uri}>") | (F.col("o") == f"<{uri}>")).count() == 0
    # Its location went with it, nobody else's did.
    places = f"p = '<{CODE}locatedAt>'"
    assert rest.where(places).count() == kg.triples.where(places).count() - 1
    assert rest.where("o like '%SourceLocation>'").count() == kg.triples.where("o like '%SourceLocation>'").count() - 1
    # Insert after delete gives the table back.
    assert crud.merge(rest, kg.triples).exceptAll(kg.triples).count() == 0


def test_incremental_update(spark, kg):
    changes = spark.createDataFrame([("src/utils.js", "modified"), ("src/other.js", "deleted")], "file_path string, event_type string")
    contents = spark.createDataFrame([("src/utils.js", "export function onlyThis() {}")], "path string, content string")
    after = pipeline.update(spark, kg, changes, contents)
    assert sorted(r[0] for r in after.entities.where("kind = 'function'").select("name").collect()) == ["onlyThis", "processUserInput", "validateUser"]


def test_turtle_and_xml_readers(spark, tmp_path):
    text = '@prefix c: <http://c/> . @base <http://b/> .\n<x> a c:T ; c:p "a\\"b"@en, 1, 2.5, true ; c:l ( 1 2 ) ; c:q [ c:r """long\n""" ] .\n# done'
    found = rdf.parse_turtle(text)
    assert ("<http://b/x>", "<http://c/p>", '"a"b"@en') in found and len(found) == 5 + 1 + 4 + 2
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="http://c/"><c:T rdf:about="http://b/x"><c:p>v</c:p><c:q rdf:resource="http://b/y"/></c:T></rdf:RDF>'
    assert len(rdf.parse_xml(xml)) == 3
    path = tmp_path / "a.nt"
    path.write_text('<a:b> <c:d> "x\\n\\u00e9\\\\n"^^<http://www.w3.org/2001/XMLSchema#string> .\n# no\n_:b <c:d> <e:f> .\nbroken\n')
    assert sorted(r["o"] for r in rdf.read(spark, str(path)).collect()) == ['"x\né\\n"', "<e:f>"]


def test_serialise(spark):
    triples = spark.createDataFrame([("<a:b>", "<c:d#e>", '"x<&"'), ("<a:b>", "<c:d#e>", '"y"@fr')], "s string, p string, o string")
    assert len(list(rdf.serialise(triples, "nt"))) == 2
    import json

    assert json.loads("".join(rdf.serialise(triples, "json-ld")))[0]["@id"] == "a:b"
    assert len(rdf.parse_xml("\n".join(rdf.serialise(triples, "xml")))) == 2
    assert len(rdf.parse_turtle("\n".join(rdf.serialise(triples, "turtle")))) == 2
    with pytest.raises(ValueError):
        list(rdf.serialise(triples, "csv"))


def test_property_graph_files(spark, kg, tmp_path):
    vertices, edges = lowering.property_graph(kg.entities)
    property_graph.write_document(property_graph.graphml(vertices.drop("attrs"), edges), str(tmp_path / "g.graphml"))
    v, e = property_graph.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert (v.count(), e.count()) == (vertices.count(), edges.count())
    property_graph.write_document(property_graph.gexf(vertices, edges), str(tmp_path / "g.gexf"))
    v, e = property_graph.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert (v.count(), e.count()) == (vertices.count(), edges.count())
    assert property_graph.dot(vertices, edges).count() == vertices.count() + edges.count() + 2
    nodes, links = property_graph.node_link(vertices, edges)
    assert nodes.count() == vertices.count() and links.count() == edges.count()


def test_semantic_references(spark):
    entities = spark.createDataFrame([("u1", "a.js", "f", 3, 0), ("u2", "a.js", "f", 9, 1), ("u3", "b.js", "g", 1, 0)], "uri string, file_path string, name string, line_number int, ordinal int")
    refs = spark.createDataFrame([("u3", "KEY|a.js|f|6:0", "calls", "b.js"), ("KEY|a.js|f|8:2", "u3", "calls", "a.js")], "source_uri string, target_uri string, reference_type string, file_path string")
    found = {(r["source_uri"], r["target_uri"]) for r in semantic.resolve(refs, entities).collect()}
    assert found == {("u3", "u1"), ("u2", "u3")}
    merged = {r["uri"]: (r["calls_uris"], r["called_by_uris"]) for r in semantic.merge(entities, refs).collect()}
    assert merged["u3"] == (["u1"], ["u2"])
    defs = spark.createDataFrame([("u1", "a.js"), ("u3", "b.js")], "key string, file_path string")
    assert semantic.cross_file(refs.where("target_uri = 'u3'"), defs).count() == 1
    tree = spark.createDataFrame([("1", None, "a"), ("2", "1", "b"), ("3", "2", "c")], "id string, parent string, name string")
    assert sorted((r["name"], r["level"]) for r in semantic.flatten_symbols(tree).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_strong_components_by_joins(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "a")], "src string, dst string")
    want = {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
    assert {r["id"]: r["component"] for r in analytics.strong_components(edges).collect()} == want
    monkeypatch.setattr(paths, "SMALL", 0)
    assert {r["id"]: r["component"] for r in analytics.strong_components(edges).collect()} == want
    v = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    by_joins = {r["id"]: r["score"] for r in analytics.pagerank(edges, v).collect()}
    monkeypatch.undo()
    at_once = {r["id"]: r["score"] for r in analytics.pagerank(edges, v).collect()}
    assert all(abs(by_joins[k] - at_once[k]) < 1e-6 for k in at_once) and abs(sum(at_once.values()) - 1) < 1e-9


def test_neighbors_find_the_start_over_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    found = sorted((r["node"], r["depth"], ">".join(r["path"])) for r in paths.neighbors(edges, "a", 3).collect())
    assert found == [("a", 2, "a>b>a"), ("b", 1, "a>b"), ("c", 2, "a>b>c")]
    assert paths.simple_paths(edges, "none").count() == 0
    assert sorted(">".join(r["path"]) for r in paths.simple_paths(edges, "a", "c").collect()) == ["a>b>c"]


@pytest.mark.parametrize("kind", ["parquet", "graphml", "gexf"])
def test_property_store(spark, kg, tmp_path, kind):
    from lattica.api import create_store
    from lattica.plans.patterns import GraphPattern

    store = create_store(spark, str(tmp_path), "property")
    assert not store.load() and store.vertices.count() == 0
    store.add(*lowering.property_graph(kg.entities))
    uri = kg.entities.where("name = 'validateUser' and kind = 'function'").select("uri").first()[0]
    store.update_entity(uri, {"rating": "5"})
    assert store.vertices.where(F.col("id") == uri).select(F.col("attrs")["rating"]).first()[0] == "5"
    store.save(kind)
    again = create_store(spark, str(tmp_path), "property")
    assert again.load() and again.edges.count() == store.edges.count()
    if kind != "gexf":
        found = again.match(GraphPattern([{"name": "validateUser", "type": "Function"}, {"type": "Function"}], [{"relationship": "calls"}]))
        assert [r["target_Function"].rsplit("#", 1)[1] for r in found.collect()] == ["function_validateEmail_2"]
        assert again.statistics()["types"]["Class"] == 2
    assert store.context(uri, 1).count() == 1
    before = store.edges.count()
    store.delete_entity(uri)
    assert store.edges.count() == before - 2
    for shape in ("json", "graphml", "dot"):
        assert store.export(shape).count() >= store.vertices.count() + store.edges.count()
    with pytest.raises(ValueError):
        create_store(spark, str(tmp_path), "nothing")
