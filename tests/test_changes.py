"""The change stream, as a batch and as a stream."""

from pyspark.sql import functions as F

from lattica.streaming import changes

SCHEMA = "file_path string, event_type string, ts string, content_hash string"
ROWS = [
    ("a.js", "modified", "2024-01-01 00:00:00.000", "h1"),
    ("a.js", "modified", "2024-01-01 00:00:00.300", "h2"),
    ("a.js", "deleted", "2024-01-01 00:00:05.000", None),
    ("b.js", "created", "2024-01-01 00:00:01.000", "h3"),
    ("x/.git/c.js", "created", "2024-01-01 00:00:01.000", "h4"),
    ("c.txt", "created", "2024-01-01 00:00:01.000", "h5"),
]


def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def test_watched_and_debounced(spark):
    found = changes.debounce(changes.watched(table(spark)))
    assert sorted((r["file_path"], r["event_type"], r["content_hash"], r["changes"]) for r in found.collect()) == [("a.js", "deleted", None, 1), ("a.js", "modified", "h2", 2), ("b.js", "created", "h3", 1)]


def test_latest_changes_in_order_of_effect(spark):
    found = changes.latest_by_file(changes.watched(table(spark)))
    assert [(r["file_path"], r["event_type"]) for r in found.collect()] == [("a.js", "deleted"), ("b.js", "created")]
    state = spark.createDataFrame([("b.js", "h3"), ("z.js", "h")], changes.STATE)
    assert changes.changed(found, state).count() == 0
    after = changes.next_state(state, found)
    assert sorted(r["file_path"] for r in after.collect()) == ["b.js", "z.js"]


def test_affected_files(spark):
    own = spark.createDataFrame([("a.js",)], "file_path string")
    imports = spark.createDataFrame([("b.js", "a.js"), ("c.js", "b.js")], "file_path string, target string")
    assert sorted(r[0] for r in changes.affected(own, imports).collect()) == ["a.js", "b.js"]
    assert sorted(r[0] for r in changes.affected(own, imports, transitive=True).collect()) == ["a.js", "b.js", "c.js"]


def test_counts_and_maps(spark):
    entities = spark.createDataFrame([("a.js", "u1"), ("a.js", "u2"), ("b.js", "u3")], "file_path string, uri string")
    found = changes.latest_by_file(changes.watched(table(spark)))
    row = changes.counts(entities, found, entities.limit(0)).first()
    assert (row["files_processed"], row["files_deleted"], row["entities_added"], row["entities_removed"]) == (1, 1, 0, 3)
    by_file, by_uri = changes.file_maps(entities)
    assert by_file.count() == 2 and by_uri.count() == 3


def test_stream_debounce_and_batches(spark, tmp_path):
    late = [("z.js", "modified", "2024-01-02 00:00:00.000", "end")]
    source = str(tmp_path / "in")
    spark.createDataFrame(ROWS[:4], SCHEMA).coalesce(1).write.json(source)
    stream = spark.readStream.schema(SCHEMA).json(source).withColumn("ts", F.col("ts").cast("timestamp"))
    query = changes.debounced_stream(stream).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").json(source)
    query = changes.debounced_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    # The last burst stays open until the watermark passes it.
    assert sorted((r["file_path"], r["event_type"]) for r in found.collect()) == [("a.js", "deleted"), ("a.js", "modified"), ("b.js", "created")]
    seen: list[tuple] = []
    query = changes.run(stream, lambda batch, k: seen.extend(tuple(r)[:2] for r in batch.collect()), str(tmp_path / "cp3"))
    query.awaitTermination(120)
    assert sorted(seen) == [("a.js", "deleted"), ("b.js", "created"), ("z.js", "modified")]


def test_updater_follows_a_stream(spark, tmp_path):
    from lattica.engine import QueryEngine
    from lattica.streaming.updater import Updater

    texts = {"a.js": "import { g } from './b';\nfunction f() { return g(); }\n", "b.js": "export function g() { return 1; }\n"}

    def contents(wanted):
        known = spark.createDataFrame(list(texts.items()), "file_path string, content string")
        return known.join(wanted, "file_path").select(F.col("file_path").alias("path"), "content")

    def called(updater):
        return sorted((r["a"], r["b"]) for r in QueryEngine(updater.graph).sparql("SELECT ?a ?b WHERE { ?f code:calls ?g ; code:hasName ?a . ?g code:hasName ?b }").rows())

    updater = Updater(spark, str(tmp_path / "graph"), contents)
    source = str(tmp_path / "in")
    first = [("a.js", "created", "2024-01-01 00:00:00", "1"), ("b.js", "created", "2024-01-01 00:00:00", "2"), ("c.txt", "created", "2024-01-01 00:00:00", "3")]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.json(source)
    stream = spark.readStream.schema(SCHEMA).json(source).withColumn("ts", F.col("ts").cast("timestamp"))
    updater.follow(stream, str(tmp_path / "cp")).awaitTermination(200)
    assert called(updater) == [("f", "g")] and updater.statistics()["files"] == 2
    again = spark.createDataFrame(first[:2], SCHEMA)
    assert updater.apply(again, 5).files_processed == 0
    texts["b.js"] = "export function h() { return 1; }\n"
    result = updater.apply(spark.createDataFrame([("b.js", "modified", "2024-01-01 00:00:09", "4")], SCHEMA), 6)
    assert (result.files_processed, result.entities_removed, result.affected_files) == (1, 2, 2) and called(updater) == []
    # The same batch again changes nothing.
    assert updater.apply(spark.createDataFrame([("b.js", "deleted", "2024-01-01 00:00:09", None)], SCHEMA), 6).files_deleted == 0
    result = updater.apply(spark.createDataFrame([("b.js", "deleted", "2024-01-01 00:00:10", None)], SCHEMA), 7)
    assert result.files_deleted == 1 and updater.statistics()["files"] == 1
