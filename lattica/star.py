"""A star schema as a graph: a direct mapping of tables, and a call graph derived from them.

Every key is an IRI, every column a predicate, foreign keys lead to other
IRIs.  The call graph links a supplier to the one that most often stands on
the next line of the same order, and to the one two lines on; ties go to the
smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.terms import CODE, KG, RDF_TYPE
from lattica.graph import Fixed, Graph, Key, Value


def kg(local: str) -> str:
    return f"<{KG}{local}>"


def code(local: str) -> str:
    return f"<{CODE}{local}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) supplier keys of the call graph.

    Lines of an order meet in blocks of 16 numbers, so one exchange serves both
    sides; the last two numbers of a block also meet the first two of the next.
    """
    lines, block = table(spark, sf_dir, "lineitem"), F.shiftright("l_linenumber", 4)

    def met(ahead: DataFrame, after: DataFrame, at: Column) -> DataFrame:
        ahead = ahead.select("l_orderkey", at.alias("at"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("src"))
        after = after.select("l_orderkey", block.alias("at"), F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("dst"))
        return ahead.join(after, ["l_orderkey", "at"]).select("src", (F.col("m") - F.col("n")).alias("gap"), "dst").where("src <> dst and gap in (1, 2)")

    pairs = met(lines, lines, block).union(met(lines.where("l_linenumber & 15 >= 14"), lines.where("l_linenumber & 15 <= 1"), block + 1))
    counted = pairs.groupBy("src", "gap", "dst").agg(F.count(F.lit(1)).alias("n"))
    # Of each count the smallest, then that of the largest count: both aggregates hash, one over structs would sort.
    least = counted.groupBy("src", "gap", "n").agg(F.min("dst").alias("dst"))
    return least.groupBy("src", "gap").agg(F.max_by("dst", "n").alias("dst")).select("src", "dst").distinct()


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of the call graph as names."""
    return calls(spark, sf_dir).select(*[F.concat(F.lit("s"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")])


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices (id, name, type) of the call graph."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("type"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """All tables as one graph."""
    out = Graph(spark)

    def key(name: str, column: str) -> Key:
        return Key(f"{KG}{name}/", column)

    def text(column: str) -> Value:
        return Value(column, "string")

    layout = {
        "region": ("r_regionkey", {"name": text("r_name")}),
        "nation": ("n_nationkey", {"name": text("n_name"), "region": key("region", "n_regionkey")}),
        "customer": ("c_custkey", {"name": text("c_name"), "nation": key("nation", "c_nationkey"), "balance": Value("c_acctbal", "double"), "segment": text("c_mktsegment")}),
        "supplier": ("s_suppkey", {"name": text("s_name"), "nation": key("nation", "s_nationkey"), "balance": Value("s_acctbal", "double")}),
        "part": ("p_partkey", {"name": text("p_name"), "brand": text("p_brand"), "kind": text("p_type"), "size": Value("p_size", "integer"), "price": Value("p_retailprice", "double")}),
        "orders": ("o_orderkey", {"customer": key("customer", "o_custkey"), "status": text("o_orderstatus"), "total": Value("o_totalprice", "double"), "priority": text("o_orderpriority")}),
    }
    for name, (column, values) in layout.items():
        made = {RDF_TYPE: Fixed(kg(name.capitalize()))} | {kg(p): v for p, v in values.items()}
        out.register(name, table(spark, sf_dir, name), key(name, column), made)
    # A supplier delivers many parts, and calls others.
    out.register("lineitem", table(spark, sf_dir, "lineitem"), key("supplier", "l_suppkey"), {kg("delivers"): key("part", "l_partkey")}, single=False)
    out.register("calls", calls(spark, sf_dir), key("supplier", "src"), {code("calls"): key("supplier", "dst")}, single=False)
    return out


def triples(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The triples of one table of the graph."""
    g = graph(spark, sf_dir)
    g.mappings = [m for m in g.mappings if m.table == name]
    return g.triples()
