"""The change stream: debounce, detection, upserts and dependent files.

A change is (file_path, event_type, ts, content_hash).  The same column
expressions serve a batch of changes and a stream; late changes beyond the
watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.sources.files import WATCH_IGNORED_DIRS, discovered

#: Order in which the changes of one batch take effect.
RANK = {"deleted": 0, "modified": 1, "created": 2}
STATE = "file_path string, content_hash string"


def rank(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type == kind, F.lit(k)) for kind, k in RANK.items()], F.lit(len(RANK)))


def watched(changes: DataFrame) -> DataFrame:
    """Changes of source files outside hidden and ignored folders."""
    return changes.where(discovered(F.col("file_path"), ignored=WATCH_IGNORED_DIRS))


def debounce(changes: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """The last change of every burst: of a file's changes less than ``gap`` apart."""
    latest = F.max_by(F.struct("event_type", "content_hash", "ts"), F.struct("ts", "event_type"))
    bursts = changes.groupBy("file_path", F.session_window("ts", gap).alias("burst")).agg(latest.alias("last"), F.count(F.lit(1)).alias("changes"))
    return bursts.select("file_path", "last.event_type", "last.ts", "last.content_hash", "changes", F.col("burst.start").alias("since"))


def debounced_stream(changes: DataFrame, gap: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """:func:`debounce` over a stream; a burst is emitted once the watermark has passed it."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    return debounce(timed.withWatermark("ts", late), gap)


def latest_by_file(changes: DataFrame) -> DataFrame:
    """The last change of each file of a batch, in order of effect."""
    last = F.max_by(F.struct("event_type", "content_hash", "ts"), F.struct("ts", "event_type")).alias("last")
    return changes.groupBy("file_path").agg(last).select("file_path", "last.*").orderBy(rank(F.col("event_type")), "file_path")


def changed(changes: DataFrame, state: DataFrame) -> DataFrame:
    """Changes that change something: deletions of known files, and contents that differ from the known one."""
    known = state.select("file_path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    joined = changes.join(known, "file_path", "left")
    gone = (F.col("event_type") == "deleted") & F.col("known").isNotNull()
    new = (F.col("event_type") != "deleted") & ~F.col("content_hash").eqNullSafe(F.col("old_hash"))
    return joined.where(gone | new).drop("old_hash", "known")


def next_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The hash of each file after the changes."""
    rest = state.join(changes.select("file_path"), "file_path", "left_anti").select("file_path", "content_hash")
    return rest.unionByName(changes.where("event_type <> 'deleted'").select("file_path", "content_hash"))


def upsert(entities: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after the changes: all of a changed file's go, then what it holds now comes in."""
    kept = entities.join(changes.select("file_path").distinct(), "file_path", "left_anti").select(*entities.columns)
    return kept.unionByName(new.select(*entities.columns))


def counts(entities: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """One row: files_processed, files_deleted, entities_added, entities_removed."""
    gone = entities.join(changes.select("file_path").distinct(), "file_path", "left_semi").agg(F.count(F.lit(1)).alias("entities_removed"))
    files = changes.agg(F.count_if(F.col("event_type") != "deleted").alias("files_processed"), F.count_if(F.col("event_type") == "deleted").alias("files_deleted"))
    return files.crossJoin(new.agg(F.count(F.lit(1)).alias("entities_added"))).crossJoin(gone)  # single rows


def file_maps(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_path, uris) and (uri, files)."""
    pairs = entities.select("file_path", "uri").distinct()
    by_file = pairs.groupBy("file_path").agg(F.array_sort(F.collect_set("uri")).alias("uris"))
    return by_file, pairs.groupBy("uri").agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def file_dependencies(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_path, depends_on) and (file_path, dependents) from (file_path, target)."""
    pairs = imports.select("file_path", "target").distinct()
    ahead = pairs.groupBy("file_path").agg(F.array_sort(F.collect_set("target")).alias("depends_on"))
    back = pairs.groupBy(F.col("target").alias("file_path")).agg(F.array_sort(F.collect_set("file_path")).alias("dependents"))
    return ahead, back


def affected(changes: DataFrame, imports: DataFrame, transitive: bool = False) -> DataFrame:
    """Changed files and those that import them, directly or over any number of steps."""
    own = changes.select("file_path").distinct()
    edges = imports.select(F.col("target").alias("src"), F.col("file_path").alias("dst")).distinct()
    if transitive:
        from lattica.operators.paths import closure

        edges = closure(edges)
    reached = edges.join(own.withColumnRenamed("file_path", "src"), "src").select(F.col("dst").alias("file_path"))
    return own.union(reached).distinct()


def run(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feed each micro-batch's latest changes to ``apply(changes, batch_id)``.

    Without ``every`` (a processing-time interval) what is there is processed
    and the query ends.
    """
    writer = watched(changes).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, k: apply(latest_by_file(batch), k)).start()
