"""A small code base as a graph: build it, ask it, change it."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica import pipeline
from lattica.api import build, create_engine
from lattica.operators import analytics, lowering, validate
from lattica.streaming.updater import Updater

FILES = {
    "lib/store.js": "export async function queryOrders(id) { return []; }\nexport async function saveOrder(order) { return order; }\n",
    "lib/checks.js": "export function checkOrder(order) { return Boolean(order); }\nfunction neverCalled() { return 1; }\n",
    "services/orders.js": "import { queryOrders, saveOrder } from '../lib/store';\nimport { checkOrder } from '../lib/checks';\nexport class OrderService {\n  async list(id) { return queryOrders(id); }\n  async add(order) {\n    if (checkOrder(order)) { return saveOrder(order); }\n    return null;\n  }\n}\n",
    "handlers/orders.js": "import { OrderService } from '../services/orders';\nexport async function handleAdd(req, res) { const s = new OrderService(); return s.add(req.body); }\n",
}
QUERIES = {
    "database operations": "SELECT DISTINCT ?name WHERE { ?f code:calls ?g ; code:hasName ?name . ?g code:hasName ?n FILTER(REGEX(?n, '^(query|save)')) }",
    "handlers": 'SELECT ?name WHERE { ?f a code:Function ; code:hasName ?name FILTER(STRSTARTS(?name, "handle")) }',
    "methods of each class": "SELECT ?name (COUNT(?m) AS ?n) WHERE { ?c a code:Class ; code:hasName ?name ; code:hasMethod ?m } GROUP BY ?name",
    "asynchronous functions": "SELECT ?name WHERE { ?f a code:Function ; code:isAsync true ; code:hasName ?name } ORDER BY ?name",
}


def upkeep(spark: SparkSession) -> None:
    """The same files kept current on disk, from batches of changes."""
    texts = dict(FILES)

    def contents(wanted):
        known = spark.createDataFrame(list(texts.items()), "path string, content string")
        return known.join(wanted.withColumnRenamed("file_path", "path"), "path", "left_semi")

    def batch(names, kind):
        rows = [(name, kind, str(hash(texts[name]))) for name in names]
        return spark.createDataFrame(rows, "file_path string, event_type string, content_hash string").withColumn("ts", F.current_timestamp())

    updater = Updater(spark, tempfile.mkdtemp(prefix="demo-graph-"), contents)
    print("built", updater.apply(batch(texts, "created"), 0))
    texts["lib/store.js"] += "export function closeStore() { return true; }\n"
    print("updated", updater.apply(batch(["lib/store.js"], "modified"), 1))
    print("kept", updater.statistics())


def main() -> None:
    spark = SparkSession.builder.master("local[*]").appName("demo").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="demo-")
    for name, text in FILES.items():
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    graph = build(spark, folder)
    print(graph.statistics)
    engine = create_engine(graph)
    for title, text in QUERIES.items():
        print(title, engine.sparql(text).rows())
    for sentence in ("Find unused functions", "Which functions are calling checkOrder?"):
        print(sentence, engine.ask_sentence(sentence).rows())
    service = "http://codebase.local/services/orders.js#class_OrderService_3"
    for row in graph.context(service, 2).rows()[:10]:
        print("around the service", row["hop"], row["direction"], row["p"].rsplit("#", 1)[-1], row["label"])
    vertices, edges = lowering.property_graph(graph.entities)
    print("statistics", analytics.statistics(edges, vertices).first().asDict())
    for row in analytics.pagerank(edges, vertices).orderBy("score", ascending=False).limit(3).collect():
        print("central", row["id"], round(row["score"], 4))
    print("issues", graph.issues().count(), "public", validate.public_api(graph.entities).count())
    changes = spark.createDataFrame([("lib/checks.js", "modified")], "file_path string, event_type string")
    contents = spark.createDataFrame([("lib/checks.js", "export function checkOrder(order) { return true; }")], "path string, content string")
    after = create_engine(pipeline.update(spark, graph, changes, contents))
    print("after the change", after.ask_sentence("Find unused functions").rows())
    upkeep(spark)
    spark.stop()


if __name__ == "__main__":
    main()
