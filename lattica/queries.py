"""The registered queries of the graph engine, each with its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import star
from lattica.engine import QueryEngine
from lattica.functions import terms
from lattica.functions.staging import stage
from lattica.functions.terms import KG
from lattica.graph import Graph
from lattica.operators import analytics, crud, paths, semantic, spans, validate
from lattica.plans import patterns, templates
from lattica.plans.compiler import sparql
from lattica.sources import files, property_graph, rdf
from lattica.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The call graph in SQL; every query over it begins with this.
CALLS = """counted AS (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst, b.l_linenumber - a.l_linenumber AS gap, count(*) AS n FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND (b.l_linenumber = a.l_linenumber + 1 OR b.l_linenumber = a.l_linenumber + 2)
  WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2, 3
), ranked AS (SELECT src, dst, row_number() OVER (PARTITION BY src, gap ORDER BY n DESC, dst) AS k FROM counted),
calls AS (SELECT DISTINCT src, dst FROM ranked WHERE k = 1), named AS (SELECT 's' || src AS src, 's' || dst AS dst FROM calls)"""
CLOSED = CALLS + """, closed AS (SELECT src, dst FROM named UNION SELECT c.src, e.dst FROM closed c JOIN named e ON c.dst = e.src)"""


def query(sql: str | None = None, name: str | None = None):
    def out(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return out


def text_query(name: str, text: str, sql: str) -> None:
    """Register SPARQL text over the star graph."""
    query(sql, name)(lambda spark, sf_dir: sparql(star.graph(spark, sf_dir), text))


def _supplier(key: str) -> str:
    return f"'{KG}supplier/' || {key}"


# Basic graph patterns, filters and aggregates.
text_query(
    "bgp_customer_nation_region",
    "SELECT ?customer ?nation ?region WHERE { ?c a kg:Customer ; kg:name ?customer ; kg:nation ?n . ?n kg:name ?nation ; kg:region ?r . ?r kg:name ?region }",
    "SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
text_query(
    "class_method_counts",
    "SELECT ?name (COUNT(?p) AS ?parts) WHERE { ?s a kg:Supplier ; kg:name ?name ; kg:delivers ?p } GROUP BY ?name ORDER BY DESC(?parts)",
    "SELECT s_name AS name, count(DISTINCT l_partkey)::VARCHAR AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
)
text_query(
    "having_many_params",
    "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o a kg:Orders ; kg:customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 12)",
    f"SELECT '{KG}customer/' || o_custkey AS c, count(*)::VARCHAR AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
)
text_query(
    "having_many_calls",
    "SELECT ?s (COUNT(?t) AS ?n) WHERE { ?s code:calls ?t } GROUP BY ?s HAVING (?n > 1)",
    f"WITH {CALLS} SELECT {_supplier('src')} AS s, count(*)::VARCHAR AS n FROM calls GROUP BY src HAVING count(*) > 1",
)
text_query(
    "filter_contains_lcase",
    'SELECT ?p ?kind WHERE { ?p a kg:Part ; kg:kind ?kind FILTER(CONTAINS(LCASE(?kind), "eco") || CONTAINS(LCASE(?kind), "small")) }',
    f"SELECT '{KG}part/' || p_partkey AS p, p_type AS kind FROM part WHERE contains(lower(p_type), 'eco') OR contains(lower(p_type), 'small')",
)
text_query(
    "filter_regex",
    'SELECT ?name WHERE { ?p a kg:Part ; kg:name ?name FILTER(REGEX(?name, "^SMALL.*ing$", "i") && ?name != "x") }',
    "SELECT p_name AS name FROM part WHERE regexp_matches(p_name, '^SMALL.*ing$', 'i')",
)
text_query(
    "filter_numeric_range",
    "SELECT ?p ?size WHERE { ?p a kg:Part ; kg:size ?size ; kg:price ?price FILTER(?size >= 10 && ?size < 20 && ?price > 950) }",
    f"SELECT '{KG}part/' || p_partkey AS p, p_size::VARCHAR AS size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950",
)
text_query(
    "minus_unused",
    "SELECT ?s ?name WHERE { ?s a kg:Supplier ; kg:name ?name MINUS { ?other code:calls ?s } }",
    f"WITH {CALLS} SELECT {_supplier('s_suppkey')} AS s, s_name AS name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = s_suppkey)",
)
text_query("ask_exists", "ASK { ?p a kg:Part ; kg:size 7 }", "SELECT CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_size = 7) THEN 'true' ELSE 'false' END AS result")
text_query(
    "optional_bind_values",
    'SELECT ?name ?rich ?label WHERE { VALUES ?segment { "BUILDING" "MACHINERY" } ?c a kg:Customer ; kg:name ?name ; kg:segment ?segment OPTIONAL { ?c kg:balance ?rich FILTER(?rich > 5000) } BIND(CONCAT(?name, "/", ?segment) AS ?label) }',
    "SELECT c_name AS name, CASE WHEN c_acctbal > 5000 THEN c_acctbal::VARCHAR END AS rich, c_name || '/' || c_mktsegment AS label FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
text_query(
    "distinct_offset",
    "SELECT DISTINCT ?brand WHERE { ?p a kg:Part ; kg:brand ?brand } ORDER BY ?brand OFFSET 2 LIMIT 10",
    "SELECT DISTINCT p_brand AS brand FROM part ORDER BY brand OFFSET 2 LIMIT 10",
)
text_query(
    "filter_exists",
    "SELECT ?n WHERE { ?x a kg:Nation ; kg:name ?n FILTER EXISTS { ?s a kg:Supplier ; kg:nation ?x } FILTER NOT EXISTS { ?c a kg:Customer ; kg:nation ?x ; kg:balance ?b FILTER(?b > 9990) } }",
    "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990)",
)
text_query(
    "aggregate_forms",
    'SELECT ?brand (COUNT(*) AS ?n) (COUNT(DISTINCT ?kind) AS ?kinds) (SUM(?size) AS ?total) (MIN(?size) AS ?least) (MAX(?size) AS ?most) (GROUP_CONCAT(DISTINCT ?kind; SEPARATOR="|") AS ?all) WHERE { ?p a kg:Part ; kg:brand ?brand ; kg:size ?size ; kg:kind ?kind } GROUP BY ?brand',
    "SELECT p_brand AS brand, count(*)::VARCHAR AS n, count(DISTINCT p_type)::VARCHAR AS kinds, sum(p_size)::VARCHAR AS total, min(p_size)::VARCHAR AS least, max(p_size)::VARCHAR AS most, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS \"all\" FROM part GROUP BY p_brand",
)
text_query(
    "string_functions",
    'SELECT ?name (STRLEN(?name) AS ?n) (UCASE(?name) AS ?up) (SUBSTR(?name, 2, 3) AS ?cut) (STRBEFORE(?name, "#") AS ?head) (STRAFTER(?name, "#") AS ?tail) (REPLACE(?name, "0+", "-") AS ?short) (MD5(?name) AS ?md5) (SHA256(?name) AS ?sha) WHERE { ?s a kg:Supplier ; kg:name ?name }',
    "SELECT s_name AS name, length(s_name)::VARCHAR AS n, upper(s_name) AS up, substr(s_name, 2, 3) AS cut, CASE WHEN contains(s_name, '#') THEN split_part(s_name, '#', 1) ELSE '' END AS head, CASE WHEN contains(s_name, '#') THEN substr(s_name, instr(s_name, '#') + 1) ELSE '' END AS tail, regexp_replace(s_name, '0+', '-', 'g') AS short, md5(s_name) AS md5, sha256(s_name) AS sha FROM supplier",
)
text_query(
    "numeric_functions",
    "SELECT ?p (?size * 2 + 1 AS ?odd) (CEIL(?price) AS ?up) (FLOOR(?price) AS ?down) (IF(?size > 25, \"big\", \"small\") AS ?class) (COALESCE(?none, ?size) AS ?first) WHERE { ?p a kg:Part ; kg:size ?size ; kg:price ?price FILTER(?size IN (1, 2, 3) || ISNUMERIC(?size) && ABS(-?size) > 40) }",
    f"SELECT '{KG}part/' || p_partkey AS p, (p_size * 2 + 1)::VARCHAR AS odd, ceil(p_retailprice)::BIGINT::VARCHAR AS up, floor(p_retailprice)::BIGINT::VARCHAR AS down, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class, p_size::VARCHAR AS first FROM part WHERE p_size IN (1, 2, 3) OR p_size > 40",
)
text_query(
    "subquery_top",
    "SELECT ?name ?n WHERE { { SELECT ?x (COUNT(?c) AS ?n) WHERE { ?c a kg:Customer ; kg:nation ?x } GROUP BY ?x } ?x kg:name ?name FILTER(?n > 5) }",
    "SELECT n_name AS name, n::VARCHAR AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON n_nationkey = c_nationkey WHERE n > 5",
)
text_query(
    "path_sequence_inverse",
    "SELECT DISTINCT ?region ?order WHERE { ?region ^(kg:nation/kg:region)/^kg:customer ?order . ?order kg:priority \"1-URGENT\" }",
    f"SELECT DISTINCT '{KG}region/' || n_regionkey AS region, '{KG}orders/' || o_orderkey AS \"order\" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'",
)
text_query(
    "path_alternative_optional",
    f"SELECT DISTINCT ?x WHERE {{ <{KG}supplier/1> (code:calls|^code:calls)? ?x }}",
    f"WITH {CALLS} SELECT {_supplier('dst')} AS x FROM calls WHERE src = 1 UNION SELECT {_supplier('src')} FROM calls WHERE dst = 1 UNION SELECT {_supplier('1')}",
)
text_query(
    "path_star_from",
    f"SELECT ?x WHERE {{ <{KG}supplier/1> code:calls* ?x }}",
    f"WITH RECURSIVE {CLOSED} SELECT '{KG}supplier/' || substr(dst, 2) AS x FROM closed WHERE src = 's1' UNION SELECT {_supplier('1')}",
)
text_query(
    "union_in_out_context",
    f"SELECT ?way ?p ?other WHERE {{ {{ <{KG}supplier/1> ?p ?other BIND(\"out\" AS ?way) }} UNION {{ ?other ?p <{KG}supplier/1> BIND(\"in\" AS ?way) }} }}",
    f"WITH {CALLS} SELECT 'out' AS way, '{KG}name' AS p, s_name AS other FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 'out', '{KG}nation', '{KG}nation/' || s_nationkey FROM supplier WHERE s_suppkey = 1 "
    f"UNION ALL SELECT 'out', '{KG}balance', s_acctbal::VARCHAR FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 'out', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{KG}Supplier' FROM supplier WHERE s_suppkey = 1 "
    f"UNION ALL SELECT DISTINCT 'out', '{KG}delivers', '{KG}part/' || l_partkey FROM lineitem WHERE l_suppkey = 1 UNION ALL SELECT 'out', '{terms.CODE}calls', {_supplier('dst')} FROM calls WHERE src = 1 UNION ALL SELECT 'in', '{terms.CODE}calls', {_supplier('src')} FROM calls WHERE dst = 1",
)
text_query(
    "construct_called_by",
    "CONSTRUCT { ?b code:calledBy ?a } WHERE { ?a code:calls ?b }",
    f"WITH {CALLS} SELECT '<' || {_supplier('dst')} || '>' AS s, '<{terms.CODE}calledBy>' AS p, '<' || {_supplier('src')} || '>' AS o FROM calls",
)
text_query(
    "describe_region",
    f"DESCRIBE <{KG}region/1>",
    f"SELECT '<{KG}region/' || r_regionkey || '>' AS s, '<{KG}name>' AS p, '\"' || r_name || '\"' AS o FROM region WHERE r_regionkey = 1 UNION ALL SELECT '<{KG}region/' || r_regionkey || '>', '{terms.RDF_TYPE}', '<{KG}Region>' FROM region WHERE r_regionkey = 1",
)


@query("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Orders', count(*) FROM orders")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.graph(spark, sf_dir).types().select("label", "n")


@query(f"SELECT '{KG}part/' || p_partkey AS node0 FROM part WHERE p_brand = 'Brand#13'")
def wildcard_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = star.table(spark, sf_dir, "part")
    node = F.concat(F.lit(f"<{KG}part/"), F.col("p_partkey").cast("string"), F.lit(">"))
    rows = parts.select(node.alias("s"), F.lit(f"<{terms.CODE}brand>").alias("p"), terms.typed_term(F.col("p_brand"), "string").alias("o"))
    pattern = patterns.GraphPattern([{"brand": "Brand#13"}], filters={"node0": f"{KG}part/*"})
    return patterns.match(Graph.of(rows), pattern)


@query(f"WITH {CALLS}, v AS (SELECT 's' || s_suppkey AS id, s_name AS name, n_name AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT v.id, v.name, min(w.id) AS target FROM v JOIN named e ON v.id = e.src JOIN v w ON w.id = e.dst AND w.type <> v.type WHERE v.type <> w.type GROUP BY v.id, v.name", "property_pattern")
def property_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that call one of another nation: the smallest such."""
    v, e = star.suppliers(spark, sf_dir), star.call_edges(spark, sf_dir)
    edges = e.join(v.select(F.col("id").alias("src"), F.col("type").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("type").alias("b")), "dst")
    edges = edges.select("src", "dst", F.when(F.col("a") == F.col("b"), "inner").otherwise("outer").alias("relationship"), F.lit("calls").alias("type"))
    found = patterns.match_property_graph(v, edges, patterns.GraphPattern([{}], [{"relationship": "outer"}]))
    return found.select("id", "name", F.col("target_outer").alias("target"))


@query("SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey)")
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = star.suppliers(spark, sf_dir)
    return analytics.nodes_by_type(v, v.agg(F.min("type")).first()[0]).select("id", "name")


# Templates and sentences over the call graph.
def _code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers as functions of the call graph."""
    graph = Graph(spark)
    supplier = star.table(spark, sf_dir, "supplier")
    key = star.Key(f"{KG}supplier/", "s_suppkey")
    exported = supplier.withColumn("exported", F.col("s_acctbal") > 5000)
    graph.register("functions", exported, key, {terms.RDF_TYPE: star.Fixed(star.code("Function")), star.code("hasName"): star.Value("s_name", "string"), star.code("isExported"): star.Value("exported", "boolean")})
    graph.register("calls", star.calls(spark, sf_dir), star.Key(f"{KG}supplier/", "src"), {star.code("calls"): star.Key(f"{KG}supplier/", "dst"), star.code("imports"): star.Key(f"{KG}supplier/", "dst")}, single=False)
    return graph


def _template(name: str, sql: str, **values: object) -> None:
    query(sql, f"template_{name}")(lambda spark, sf_dir: QueryEngine(_code_graph(spark, sf_dir)).template(name, **values).df)


_template("functions_calling_function", f"WITH {CALLS} SELECT {_supplier('src')} AS caller, s_name AS callerName FROM calls JOIN supplier ON s_suppkey = src WHERE dst = 1", target_function=f"{KG}supplier/1")
_template("functions_called_by_function", f"WITH {CALLS} SELECT {_supplier('dst')} AS callee, s_name AS calleeName FROM calls JOIN supplier ON s_suppkey = dst WHERE src = 1", source_function=f"{KG}supplier/1")
_template("call_chain_between_functions", f"WITH RECURSIVE {CLOSED} SELECT '{KG}supplier/' || substr(a.dst, 2) AS intermediate FROM closed a JOIN closed b ON a.dst = b.src WHERE a.src = 's1' AND b.dst = 's2'", source_function=f"{KG}supplier/1", target_function=f"{KG}supplier/2")
_template("circular_dependencies", f"WITH RECURSIVE {CLOSED} SELECT '{KG}supplier/' || substr(e.src, 2) AS module1, '{KG}supplier/' || substr(e.dst, 2) AS module2 FROM named e JOIN closed c ON c.src = e.dst AND c.dst = e.src")
_template("unused_functions", f"WITH {CALLS} SELECT {_supplier('s_suppkey')} AS function, s_name AS functionName FROM supplier WHERE NOT s_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM calls WHERE dst = s_suppkey)")
_template("high_complexity_functions", f"WITH {CALLS} SELECT {_supplier('src')} AS function, s_name AS functionName, count(*)::VARCHAR AS callCount FROM calls JOIN supplier ON s_suppkey = src GROUP BY src, s_name HAVING count(*) > 1", complexity_threshold=1)


# Paths and analytics.
@query(f"WITH RECURSIVE {CLOSED} SELECT src, dst FROM closed")
def closure_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.closure(star.call_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSED} SELECT src, dst FROM closed")
def closure_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.closure_loop(stage(spark, star.call_edges(spark, sf_dir), "calls"))


@query(f"WITH RECURSIVE {CLOSED} SELECT src, dst FROM closed WHERE dst = 's1'")
def closure_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.closure(star.call_edges(spark, sf_dir), end="s1")


@query(f"WITH RECURSIVE {CALLS}, reach AS (SELECT dst AS node, 1 AS depth FROM named WHERE src = 's1' UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN named e ON e.src = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM reach GROUP BY node")
def bfs_neighbors_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.neighbors(star.call_edges(spark, sf_dir), "s1", 3).select("node", "depth")


@query(f"WITH RECURSIVE {CALLS}, walk AS (SELECT ['s1', dst] AS path FROM named WHERE src = 's1' UNION ALL SELECT list_append(w.path, e.dst) FROM walk w JOIN named e ON e.src = w.path[-1] WHERE len(w.path) < 5 AND NOT list_contains(w.path, e.dst)) SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM walk")
def simple_paths_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.simple_paths(star.call_edges(spark, sf_dir), "s1", cutoff=4)
    return found.select(F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


@query(f"WITH RECURSIVE {CLOSED}, nodes AS (SELECT src AS id FROM named UNION SELECT dst FROM named) SELECT n.id, least(n.id, coalesce(min(a.dst), n.id)) AS component FROM nodes n LEFT JOIN (SELECT a.src, a.dst FROM closed a JOIN closed b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.id GROUP BY n.id")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.strong_components(star.call_edges(spark, sf_dir))


@query(f"WITH {CALLS}, ends AS (SELECT src AS id FROM named UNION ALL SELECT dst FROM named) SELECT 's' || s_suppkey AS id, round(count(ends.id) / ((SELECT count(*) FROM supplier) - 1), 9) AS score FROM supplier LEFT JOIN ends ON ends.id = 's' || s_suppkey GROUP BY s_suppkey")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.degree_centrality(star.call_edges(spark, sf_dir), star.suppliers(spark, sf_dir))
    return found.select("id", F.round("score", 9).alias("score"))


def _pagerank_sql(rounds: int) -> str:
    out = [CALLS, "n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM supplier)", "e AS MATERIALIZED (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM named)", "r0 AS MATERIALIZED (SELECT 's' || s_suppkey AS id, 1.0::DOUBLE / n AS score FROM supplier, n)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT r.id, 0.85 * (coalesce((SELECT sum(p.score * e.share) FROM e JOIN r{k} p ON p.id = e.src WHERE e.dst = r.id), 0) + coalesce((SELECT sum(p.score) FROM r{k} p WHERE p.id NOT IN (SELECT src FROM e)), 0) / n) + 0.15 / n AS score FROM r{k} r, n)")
    return f"WITH {', '.join(out)} SELECT id, round(score, 9) AS score FROM r{rounds}"


@query(_pagerank_sql(15))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.pagerank(star.call_edges(spark, sf_dir), star.suppliers(spark, sf_dir), iterations=15, tolerance=0.0)
    return found.select("id", F.round("score", 9).alias("score"))


@query(
    f"WITH {CALLS}, w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM named GROUP BY 1, 2), sym AS (SELECT a AS x, b AS y, w FROM w UNION ALL SELECT b, a, w FROM w), "
    "tri AS (SELECT p.x AS id, sum(p.w * q.w * r.w) / 2.0 AS t FROM sym p JOIN sym q ON q.x = p.y JOIN sym r ON r.x = q.y AND r.y = p.x GROUP BY p.x), deg AS (SELECT x AS id, sum(w) AS d, sum(CASE WHEN w = 2 THEN 1 ELSE 0 END) AS m FROM sym GROUP BY x) "
    "SELECT 's' || s_suppkey AS id, round(CASE WHEN d * (d - 1) - 2 * m > 0 THEN coalesce(t, 0) / (d * (d - 1) - 2 * m) ELSE 0 END, 9)::DOUBLE AS score FROM supplier LEFT JOIN deg ON deg.id = 's' || s_suppkey LEFT JOIN tri ON tri.id = 's' || s_suppkey"
)
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.clustering(star.call_edges(spark, sf_dir), star.suppliers(spark, sf_dir))
    return found.select("id", F.round("score", 9).alias("score"))


@query(f"WITH {CALLS} SELECT (SELECT count(*) FROM supplier) AS nodes, count(*) AS edges, true AS is_directed, round(count(*)::DOUBLE / ((SELECT count(*) FROM supplier) * ((SELECT count(*) FROM supplier) - 1)), 9) AS density FROM calls")
def graph_stats_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.statistics(star.call_edges(spark, sf_dir), star.suppliers(spark, sf_dir))
    return found.select("nodes", "edges", "is_directed", F.round("density", 9).alias("density"))


# Files: documents stand for source files.
def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("."), F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "fr", "jsx").when(F.col("lang") == "de", "py").otherwise("mjs")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


_FILES = "files AS (SELECT doc_id, source || '/' || lang || '.' || CASE lang WHEN 'en' THEN 'ts' WHEN 'fr' THEN 'jsx' WHEN 'de' THEN 'py' ELSE 'mjs' END AS path, coalesce(text, '') AS text FROM documents)"


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS body_hash FROM documents")
def body_hash16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(spark, sf_dir).select("doc_id", files.short_hash(F.col("text")).alias("body_hash"))


@query("SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'), ' ')) AS ast_hash FROM documents")
def ast_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(spark, sf_dir).select("doc_id", spans.ast_hash(F.col("text")).alias("ast_hash"))


@query("SELECT doc_id, substr(coalesce(text, ''), 1, 300) AS preview FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(spark, sf_dir).select("doc_id", spans.preview(F.col("text")).alias("preview"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'py' ELSE 'javascript' END AS language, count(*) AS n FROM documents GROUP BY 1, 2")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _as_files(spark, sf_dir).withColumn("language", files.language(F.col("path")))
    return found.groupBy(F.regexp_extract("path", r"/(\w+)\.", 1).alias("lang"), "language").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FILES} SELECT path, count(*) AS n FROM files WHERE path NOT LIKE '%.py' AND octet_length(encode(text)) <= 1048576 GROUP BY path")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _as_files(spark, sf_dir).where(files.discovered(F.col("path")) & files.included(F.col("path"), F.octet_length("text")))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) SELECT doc_id, least(coalesce(list_sum(list_transform(lines[1:2], lambda x: octet_length(encode(x)) + 1)), 0) + octet_length(encode(substr(coalesce(lines[3], ''), 1, 5))), octet_length(encode(text)))::BIGINT AS byte_start FROM l"
)
def byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _as_files(spark, sf_dir).withColumn("line", F.lit(3)).withColumn("column", F.lit(5))
    return found.select("doc_id", spans.byte_offset(F.col("text"), F.col("line"), F.col("column")).cast("long").alias("byte_start"))


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = star.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return pages.select(F.col("page_id").alias("file"), F.posexplode(F.split("html", "\n")).alias("line", "text"))


_LINES = "lines AS (SELECT page_id AS file, unnest(string_split(coalesce(html, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(html, ''), chr(10)), 1) - 1 AS line FROM pages)"


@query(f"WITH {_LINES} SELECT callee, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS callee FROM lines) WHERE callee NOT IN ('if','for','while','switch','catch','return','function','typeof','new') GROUP BY callee")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.line_calls(_page_lines(spark, sf_dir)).groupBy("callee").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES}, words AS (SELECT DISTINCT file, line, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM lines), decl AS (SELECT file, unnest(regexp_extract_all(text, '\\b(?:const|let|var)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS name, line FROM lines), first AS (SELECT file, name, min(line) AS declared FROM decl GROUP BY 1, 2) SELECT file, name, declared::BIGINT AS declared, line::BIGINT AS used FROM words JOIN first USING (file, name) WHERE line >= declared")
def declared_before_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.declared_before_use(_page_lines(spark, sf_dir))
    return found.select("file", "name", F.col("declared").cast("long").alias("declared"), F.col("used").cast("long").alias("used"))


@query("SELECT p.event_id AS id, arg_min(v.event_id, struct_pack(d := abs(p.event_id - v.event_id), t := v.event_id)) AS nearest FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def nearest_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the same user's view nearest in line."""
    events = star.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    wanted = events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.col("event_id").alias("line_number"))
    known = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("line_number"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("uri"))
    return semantic.nearest(wanted, known, ["user_id"]).select("id", F.col("uri").alias("nearest"))


# Triples and their changes.
_TRIPLES = (
    f"t AS (SELECT '<{KG}customer/' || c_custkey || '>' AS s, '{terms.RDF_TYPE}' AS p, '<{KG}Customer>' AS o FROM customer UNION ALL SELECT '<{KG}customer/' || c_custkey || '>', '<{KG}name>', '\"' || c_name || '\"' FROM customer "
    f"UNION ALL SELECT '<{KG}customer/' || c_custkey || '>', '<{KG}nation>', '<{KG}nation/' || c_nationkey || '>' FROM customer UNION ALL SELECT '<{KG}customer/' || c_custkey || '>', '<{KG}balance>', '\"' || c_acctbal || '\"^^<{terms.XSD}double>' FROM customer "
    f"UNION ALL SELECT '<{KG}customer/' || c_custkey || '>', '<{KG}segment>', '\"' || c_mktsegment || '\"' FROM customer)"
)


@query(f"WITH {_TRIPLES} SELECT * FROM t")
def triples_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.triples(spark, sf_dir, "customer")


@query(f"WITH {_TRIPLES} SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM t")
def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ntriples(star.triples(spark, sf_dir, "customer"))


@query(f"WITH {_TRIPLES} SELECT s, p, o FROM t WHERE NOT (s = '<{KG}customer/7>' AND p = '<{terms.CODE}rating>') UNION ALL SELECT '<{KG}customer/7>', '<{terms.CODE}rating>', '\"5\"^^<{terms.XSD}integer>'")
def update_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crud.update(star.triples(spark, sf_dir, "customer"), f"{KG}customer/7", {"rating": 5})


@query(f"WITH {_TRIPLES} SELECT s, p, o FROM t WHERE s NOT IN (SELECT '<{KG}customer/' || c_custkey || '>' FROM customer WHERE c_acctbal < 0)")
def delete_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are deleted."""
    gone = star.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit(f"{KG}customer/"), F.col("c_custkey").cast("string")).alias("uri"))
    return crud.delete(star.triples(spark, sf_dir, "customer"), gone)


@query(f"WITH {CALLS} SELECT '<edge source=\"' || src || '\" target=\"' || dst || '\"></edge>' AS value FROM named UNION ALL SELECT '<node id=\"s' || s_suppkey || '\"><data key=\"name\">' || s_name || '</data></node>' FROM supplier")
def graphml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = star.suppliers(spark, sf_dir).select("id", "name")
    return property_graph.graphml(v, star.call_edges(spark, sf_dir)).where("place in (1, 2)").select("value")


# The change stream: events are changes of their user's file.
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = star.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".js")).alias("file_path"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("ts"), F.md5(F.col("props").cast("binary")).alias("content_hash"))


_CHANGES = "ch AS (SELECT 'u' || user_id || '.js' AS file_path, CASE event_type WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event_type, ts, md5(props) AS content_hash FROM events)"
_LATEST = f"{_CHANGES}, latest AS (SELECT file_path, event_type, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, event_type DESC) AS k FROM ch) WHERE k = 1)"


@query(
    f"WITH {_CHANGES}, cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM ch WINDOW w AS (PARTITION BY file_path ORDER BY ts)), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM cut) "
    "SELECT file_path, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS event_type, count(*) AS changes FROM runs GROUP BY file_path, run"
)
def debounce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.debounce(_changes(spark, sf_dir), "10 minutes").select("file_path", "event_type", "changes")


@query(f"WITH {_LATEST} SELECT file_path, event_type FROM latest")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_by_file(_changes(spark, sf_dir)).select("file_path", "event_type")


_STATE = "state AS (SELECT 'u' || user_id || '.js' AS file_path, md5(min(props)) AS content_hash FROM events GROUP BY user_id)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = star.table(spark, sf_dir, "events")
    return events.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".js")).alias("file_path")).agg(F.md5(F.min("props").cast("binary")).alias("content_hash"))


@query(f"WITH {_LATEST}, {_STATE} SELECT l.file_path, l.event_type FROM latest l LEFT JOIN state s USING (file_path) WHERE (l.event_type = 'deleted' AND s.file_path IS NOT NULL) OR (l.event_type <> 'deleted' AND l.content_hash IS DISTINCT FROM s.content_hash)")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.changed(changes.latest_by_file(_changes(spark, sf_dir)), _state(spark, sf_dir))
    return found.select("file_path", "event_type")


@query(f"WITH {_LATEST}, {_STATE} SELECT file_path, content_hash FROM state WHERE file_path NOT IN (SELECT file_path FROM latest) UNION ALL SELECT file_path, content_hash FROM latest WHERE event_type <> 'deleted'")
def upsert_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.next_state(_state(spark, sf_dir), changes.latest_by_file(_changes(spark, sf_dir)))


@query(f"WITH {CALLS}, changed AS (SELECT 's' || s_suppkey AS file_path FROM supplier WHERE s_acctbal < 0) SELECT file_path FROM changed UNION SELECT src FROM named WHERE dst IN (SELECT file_path FROM changed)")
def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = star.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_path"))
    return changes.affected(changed, star.call_edges(spark, sf_dir).select(F.col("src").alias("file_path"), F.col("dst").alias("target")))


@query(f"WITH {CALLS} SELECT dst AS file_path, string_agg(src, ',' ORDER BY src) AS dependents FROM named GROUP BY dst")
def dependency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, back = changes.file_dependencies(star.call_edges(spark, sf_dir).select(F.col("src").alias("file_path"), F.col("dst").alias("target")))
    return back.select("file_path", F.array_join("dependents", ",").alias("dependents"))


# Checks.
@query(f"SELECT '<{KG}doc/' || doc_id || '>' AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def validate_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are named; the labelled ones are typed."""
    graph, key = Graph(spark), star.Key(f"{KG}doc/", "doc_id")
    graph.register("documents", star.table(spark, sf_dir, "documents"), key, {star.code("hasName"): star.Value("source", "string")})
    graph.register("labels", star.table(spark, sf_dir, "labels"), key, {terms.RDF_TYPE: star.Fixed(star.code("Module"))})
    return validate.orphans(graph)


@query("SELECT uri, name, CASE WHEN contains(lower(name), 'singleton') THEN 'singleton' ELSE 'factory' END AS pattern FROM (SELECT p_partkey::VARCHAR AS uri, replace(replace(p_name, 'ring', 'Factory'), 'widget', 'Singleton') AS name FROM part) WHERE contains(lower(name), 'singleton') OR contains(lower(name), 'factory') OR contains(lower(name), 'create')")
def design_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for entities; rings are factories, widgets singletons."""
    name = F.replace(F.replace("p_name", F.lit("ring"), F.lit("Factory")), F.lit("widget"), F.lit("Singleton"))
    parts = star.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uri"), name.alias("name"))
    return validate.design_patterns(parts)


@query("SELECT s_suppkey::VARCHAR AS uri, s_name AS name FROM supplier WHERE s_acctbal > 0")
def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = star.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("uri"), F.col("s_name").alias("name"), F.lit("function").alias("kind"), F.lit("x").alias("file_path"), (F.col("s_acctbal") > 0).alias("is_exported"))
    return validate.public_api(found).select("uri", "name")
