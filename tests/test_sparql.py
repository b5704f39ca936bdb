"""SPARQL semantics on a small graph."""

import pytest

from lattica.engine import QueryEngine
from lattica.functions.terms import CODE, KG, RDF_TYPE, literal
from lattica.graph import Graph
from lattica.plans.compiler import sparql
from lattica.plans.parser import QueryError, parse
from lattica.plans.patterns import GraphPattern, match


def code(name):
    return f"<{CODE}{name}>"


def kg(name):
    return f"<{KG}{name}>"


ROWS = [
    *[(kg(f), RDF_TYPE, code("Function")) for f in ("f1", "f2", "f3")],
    (kg("f1"), code("hasName"), '"alpha"'),
    (kg("f2"), code("hasName"), '"beta"'),
    (kg("f3"), code("hasName"), '"saveAll"'),
    (kg("f1"), code("calls"), kg("f2")),
    (kg("f2"), code("calls"), kg("f3")),
    (kg("f3"), code("calls"), kg("f1")),
    (kg("f1"), code("size"), literal(10)),
    (kg("f2"), code("size"), literal(2.5)),
    (kg("f1"), code("isExported"), literal(False)),
    (kg("f2"), code("label"), '"bonjour"@fr'),
]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.of(spark.createDataFrame(ROWS, "s string, p string, o string"))


def ask(graph, text):
    return sorted(tuple(r) for r in sparql(graph, text).collect())


def test_star_and_order(graph):
    rows = sparql(graph, "SELECT ?n WHERE { ?f a code:Function ; code:hasName ?n } ORDER BY DESC(?n) LIMIT 2").collect()
    assert [r[0] for r in rows] == ["saveAll", "beta"]


def test_closure_on_a_cycle_reaches_itself(graph):
    assert len(ask(graph, "SELECT ?x ?y WHERE { ?x code:calls+ ?y }")) == 9
    assert ask(graph, "SELECT ?y WHERE { kg:f1 code:calls* ?y }") == [(f"{KG}f{k}",) for k in (1, 2, 3)]
    assert ask(graph, "ASK { kg:f1 code:calls/code:calls kg:f3 }") == [("true",)]
    assert ask(graph, "SELECT ?x WHERE { ?x ^code:calls kg:f1 }") == [(f"{KG}f2",)]


def test_star_of_a_node_without_edges(graph):
    assert ask(graph, "SELECT ?y WHERE { kg:lonely code:calls* ?y }") == [(f"{KG}lonely",)]
    assert ask(graph, "SELECT ?y WHERE { kg:lonely code:calls+ ?y }") == []


def test_optional_with_filter_in_it(graph):
    rows = ask(graph, "SELECT ?f ?s WHERE { ?f a code:Function OPTIONAL { ?f code:size ?s FILTER(?s > 3) } }")
    assert [(f[-2:], s) for f, s in rows] == [("f1", "10"), ("f2", None), ("f3", None)]


def test_minus_needs_a_shared_variable(graph):
    assert len(ask(graph, "SELECT ?f WHERE { ?f a code:Function MINUS { ?f code:size ?s } }")) == 1
    assert len(ask(graph, "SELECT ?f WHERE { ?f a code:Function MINUS { ?z code:size ?s } }")) == 3


def test_unbound_values_are_compatible_with_all(graph):
    rows = ask(graph, "SELECT ?f ?q ?s WHERE { VALUES (?f ?q) { (kg:f1 1) (UNDEF 2) } ?f code:size ?s }")
    assert [(f[-2:], q, s) for f, q, s in rows] == [("f1", "1", "10"), ("f1", "2", "10"), ("f2", "2", "2.5")]


def test_aggregates_and_having(graph):
    rows = ask(graph, "SELECT ?f (COUNT(?g) AS ?n) (SUM(?s) AS ?t) WHERE { ?f code:calls ?g ; code:size ?s } GROUP BY ?f HAVING (?n > 0)")
    assert [(n, t) for _, n, t in rows] == [("1", "10"), ("1", "2.5")]
    assert ask(graph, 'SELECT (GROUP_CONCAT(?n; separator=",") AS ?all) WHERE { ?f code:hasName ?n }') == [("alpha,beta,saveAll",)]
    assert ask(graph, "SELECT (COUNT(*) AS ?n) (AVG(?s) AS ?a) WHERE { ?f code:nothing ?s }") == [("0", "0.0")]


def test_values_of_terms(graph):
    assert ask(graph, "SELECT ?e WHERE { kg:f1 code:isExported ?e FILTER(?e = false) }") == [("false",)]
    assert ask(graph, "SELECT ?f WHERE { ?f code:size ?s FILTER(?s = 10.0) }") == [(f"{KG}f1",)]
    assert ask(graph, 'SELECT ?f WHERE { ?f code:hasName "alpha"^^xsd:string }') == [(f"{KG}f1",)]
    assert ask(graph, 'SELECT (LANG(?l) AS ?a) (STRBEFORE(?l, "j") AS ?b) WHERE { kg:f2 code:label ?l }') == [("fr", "bon")]


def test_variables_differ_by_case(graph):
    assert ask(graph, "SELECT ?Name ?name WHERE { ?f code:hasName ?Name . ?f code:label ?name }") == [("beta", "bonjour")]


def test_errors_in_filters_are_false(graph):
    assert ask(graph, "SELECT ?f WHERE { ?f code:hasName ?n FILTER(?n > 5 || ?n = \"beta\") }") == [(f"{KG}f2",)]


def test_construct_and_describe(graph):
    assert len(sparql(graph, "CONSTRUCT { ?b code:calledBy ?a } WHERE { ?a code:calls ?b }").collect()) == 3
    assert len(sparql(graph, "DESCRIBE kg:f2").collect()) == 5


def test_exists(graph):
    assert ask(graph, "SELECT ?f WHERE { ?f a code:Function FILTER NOT EXISTS { ?f code:size ?s } }") == [(f"{KG}f3",)]
    assert ask(graph, "SELECT ?f WHERE { ?f a code:Function FILTER EXISTS { ?f code:size ?s FILTER(?s > 5) } }") == [(f"{KG}f1",)]


def test_exists_within_an_expression(graph):
    text = 'SELECT ?f WHERE { ?f a code:Function ; code:hasName ?n FILTER(?n = "saveAll" || EXISTS { ?f code:isExported ?e }) }'
    assert ask(graph, text) == [(f"{KG}f1",), (f"{KG}f3",)]
    text = 'SELECT ?f WHERE { ?f a code:Function ; code:hasName ?n FILTER(?n = "alpha" || NOT EXISTS { ?f code:size ?s }) }'
    assert ask(graph, text) == [(f"{KG}f1",), (f"{KG}f3",)]


def test_negated_path(graph):
    assert ask(graph, "SELECT ?o WHERE { kg:f2 !(code:calls|a) ?o }") == [("2.5",), ("beta",), ("bonjour",)]


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x WHERE { ?x", "SELECT ?x WHERE { GRAPH <g> { ?x ?p ?o } }", "SELECT ?x WHERE { ?x nope:p ?o }", "ASK { ?a ?b ?c } extra"])
def test_what_cannot_be_read_is_an_error(text):
    with pytest.raises(QueryError):
        parse(text)


def test_engine_cache_follows_the_graph(spark):
    graph = Graph.of(spark.createDataFrame(ROWS[:3], "s string, p string, o string"))
    engine = QueryEngine(graph)
    text = "SELECT ?f WHERE { ?f a code:Function }"
    assert engine.sparql(text).count() == 3
    assert engine.sparql(text) is engine.sparql(text)
    graph.add(spark.createDataFrame([(kg("f9"), RDF_TYPE, code("Function"))], "s string, p string, o string"))
    assert engine.sparql(text).count() == 4
    assert not engine.sparql("SELECT").success
    quirky = QueryEngine(Graph.of(spark.createDataFrame(ROWS, "s string, p string, o string")), compat_falsy_null=True)
    assert quirky.sparql("SELECT ?e WHERE { kg:f1 code:isExported ?e }").rows() == [{"e": None}]


def test_engine_templates_sentences_and_context(graph):
    engine = QueryEngine(graph)
    assert [r["callerName"] for r in engine.template("functions_calling_function", target_function=f"{KG}f2").rows()] == ["alpha"]
    with pytest.raises(ValueError):
        engine.template("functions_calling_function", target_function="a> b")
    found = engine.ask_sentence("Which functions are calling saveAll?")
    assert found.context["matched_template"] == "functions_calling_function"
    assert [r["callerName"] for r in found.rows()] == ["beta"]
    assert engine.ask_sentence("good morning").rows() == []
    around = engine.context(f"{KG}f1", depth=1, relationships=["calls"]).rows()
    assert sorted((r["direction"], r["label"]) for r in around) == [("incoming", "saveAll"), ("outgoing", "beta")]
    assert engine.explain("SELECT ?x WHERE { ?x code:calls+ ?y }")["complexity"] == "low"
    assert len(engine.suggestions("function")) == 10
    timed = engine.benchmark(["ASK { ?a code:calls ?b }"], iterations=2)
    assert next(iter(timed.values()))["rows"] == 1


def test_pattern(graph):
    found = match(graph, GraphPattern([{"type": "Function", "hasName": "alpha"}, {"type": "Function"}], [{"relationship": "calls"}], {"node1": "*f2"}))
    assert [tuple(r) for r in found.collect()] == [(f"{KG}f1", f"{KG}f2")]


def test_filter_of_an_optional_reads_one_side_where_nothing_is_shared(spark, data):
    from __spark_entry__ import queries

    plan = queries()["optional_then_join"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line.split("Join ", 1)[1].strip() for line in plan.split("\n") if "Join LeftOuter" in line]
    # The rows that bind nothing meet all others without a test of each pair, and are dealt over tasks first.
    assert "LeftOuter, true" in joins and "RepartitionByExpression" in plan
