"""Property graphs to and from GraphML, GEXF, node-link JSON and DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _safe(c: Column) -> Column:
    for real, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(real), F.lit(mark))
    return c


def _data(df: DataFrame, columns: list[str]) -> Column:
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), _safe(F.col(c).cast("string")), F.lit("</data>"))).otherwise(F.lit("")) for c in columns]
    return F.concat(*parts) if parts else F.lit("")


def graphml(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GraphML document: (place, value), place 0 first and 9 last."""
    spark = vertices.sparkSession
    own, more = [c for c, k in vertices.dtypes if c != "id" and not k.startswith("map")], [c for c in edges.columns if c not in ("src", "dst")]
    keys = "".join(f'<key id="{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, cs in (("node", own), ("edge", more)) for c in cs)
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, head), (9, "</graph></graphml>")], "place int, value string")
    nodes = vertices.select(F.lit(1).alias("place"), F.concat(F.lit('<node id="'), _safe(F.col("id")), F.lit('">'), _data(vertices, own), F.lit("</node>")).alias("value"))
    links = edges.select(F.lit(2).alias("place"), F.concat(F.lit('<edge source="'), _safe(F.col("src")), F.lit('" target="'), _safe(F.col("dst")), F.lit('">'), _data(edges, more), F.lit("</edge>")).alias("value"))
    return ends.unionByName(nodes).unionByName(links)


def _values(df: DataFrame, columns: list[str]) -> Column:
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<attvalue for="{c}" value="'), _safe(F.col(c).cast("string")), F.lit('"/>'))).otherwise(F.lit("")) for c in columns]
    return F.concat(F.lit("<attvalues>"), *parts, F.lit("</attvalues>"))


def gexf(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GEXF document, attributes included: (place, value)."""
    spark = vertices.sparkSession
    own = [c for c, k in vertices.dtypes if c not in ("id", "name") and not k.startswith("map")]
    more = [c for c, k in edges.dtypes if c not in ("src", "dst", "relationship") and not k.startswith("map")]
    kinds = "".join(f'<attributes class="{k}">' + "".join(f'<attribute id="{c}" title="{c}" type="string"/>' for c in cs) + "</attributes>" for k, cs in (("node", own), ("edge", more)) if cs)
    head = f'<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.2" version="1.2"><graph defaultedgetype="directed">{kinds}<nodes>'
    ends = spark.createDataFrame([(0, head), (4, "</nodes><edges>"), (9, "</edges></graph></gexf>")], "place int, value string")
    nodes = vertices.select(F.lit(1).alias("place"), F.concat(F.lit('<node id="'), _safe(F.col("id")), F.lit('" label="'), _safe(F.coalesce("name", "id")), F.lit('">'), _values(vertices, own), F.lit("</node>")).alias("value"))
    kind = F.coalesce("relationship", F.lit("")) if "relationship" in edges.columns else F.lit("")
    links = edges.select(F.lit(5).alias("place"), F.concat(F.lit('<edge source="'), _safe(F.col("src")), F.lit('" target="'), _safe(F.col("dst")), F.lit('" label="'), _safe(kind), F.lit('">'), _values(edges, more), F.lit("</edge>")).alias("value"))
    return ends.unionByName(nodes).unionByName(links)


def write_document(lines: DataFrame, path: str, one_part: bool = True) -> None:
    """A document of lines (place, value), sorted by place: one text file, or parts that make it one after another."""
    ordered = lines.orderBy("place", "value")
    (ordered.coalesce(1) if one_part else ordered).select("value").write.mode("overwrite").text(path)


def dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a DOT document: (place, value)."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    ends = vertices.sparkSession.createDataFrame([(0, "digraph {"), (9, "}")], "place int, value string")
    nodes = vertices.select(F.lit(1).alias("place"), F.concat(quoted(F.col("id")), F.lit(" [label="), quoted(F.coalesce("name", "id")), F.lit("];")).alias("value"))
    links = edges.select(F.lit(2).alias("place"), F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.coalesce("relationship", F.lit(""))), F.lit("];")).alias("value"))
    return ends.unionByName(nodes).unionByName(links)


def node_link(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON objects of the nodes and of the links, one a row."""
    nodes = vertices.select(F.to_json(F.struct("*")).alias("value"))
    links = edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])).alias("value"))
    return nodes, links


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, attrs) and edges (src, dst, attrs) of GraphML files."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    links = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    attrs = F.coalesce(F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))), F.create_map().cast("map<string,string>"))
    return nodes.select(F.col("_id").alias("id"), attrs.alias("attrs")), links.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs.alias("attrs"))


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, name, attrs) and edges (src, dst, relationship, attrs) of GEXF files."""
    held = "attvalues struct<attvalue: array<struct<_for: string, _value: string>>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, _label string, {held}").load(path)
    links = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, _label string, {held}").load(path)
    attrs = F.coalesce(F.map_from_entries(F.transform("attvalues.attvalue", lambda d: F.struct(d["_for"], d["_value"]))), F.create_map().cast("map<string,string>")).alias("attrs")
    return nodes.select(F.col("_id").alias("id"), F.col("_label").alias("name"), attrs), links.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_label").alias("relationship"), attrs)
