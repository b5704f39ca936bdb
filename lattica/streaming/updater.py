"""Keeping a graph on disk current from micro-batches of changes.

Entities, file states and triples lie in buckets by the hash of their file.  A
batch rewrites only the buckets of changed files and, for triples, those of the
files that import them or name their types; everything else stays where an
earlier batch wrote it.  A manifest names the folder of each bucket and is
replaced in one step.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.graph import Graph
from lattica.model import ENTITY
from lattica.operators import extract, lowering
from lattica.sources.store import _Files
from lattica.streaming import changes as feed

OWNED = "file_path string, s string, p string, o string"


@dataclass(frozen=True)
class UpdateResult:
    """What one batch did."""

    files_processed: int = 0
    files_deleted: int = 0
    entities_added: int = 0
    entities_removed: int = 0
    affected_files: int = 0
    buckets_rewritten: int = 0
    seconds: float = 0.0


class Updater:
    """Entities, files and triples below a folder, in ``buckets`` buckets, after the batches so far.

    ``contents`` gives (path, content) for a table of paths (file_path).  A
    batch's buckets are written whole before the manifest moves, and a batch
    that comes again after a failure finds its number already there, so every
    batch takes effect once.  ``buckets`` is fixed by the first batch.
    """

    def __init__(self, spark: SparkSession, folder: str, contents: Callable[[DataFrame], DataFrame], buckets: int = 256):
        self.spark, self.folder, self.contents = spark, folder.rstrip("/"), contents
        self.files = _Files(spark)
        self.batches = self.changed = 0
        self.buckets = self._manifest().get("buckets", buckets)

    def _manifest(self) -> dict:
        """The last batch's number, and the folder of each bucket of each table."""
        name = f"{self.folder}/latest"
        return json.loads(self.files.read(name)) if self.files.exists(name) else {"batch": -1, "tables": {}}

    def _table(self, name: str, schema: str | T.StructType, manifest: dict, only: set[int] | None = None) -> DataFrame:
        places = manifest["tables"].get(name, {})
        paths = [f"{self.folder}/{place}" for bucket, place in places.items() if only is None or int(bucket) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, files: DataFrame) -> set[int]:
        """The buckets of files; there are no more than ``buckets``."""
        return {r[0] for r in files.select(self._bucket()).distinct().collect()}

    def _rewrite(self, name: str, rows: DataFrame, version: str, touched: set[int], manifest: dict) -> None:
        """Write the rows of the touched buckets, and note where they are."""
        target = f"{version}/{name}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{target}")
        places = manifest["tables"].setdefault(name, {})
        written = {folder for folder, _ in self.files.folders(f"{self.folder}/{target}")}
        for bucket in touched:
            places.pop(str(bucket), None)
            if f"bucket={bucket}" in written:
                places[str(bucket)] = f"{target}/bucket={bucket}"

    @property
    def entities(self) -> DataFrame:
        return self._table("entities", ENTITY, self._manifest())

    @property
    def state(self) -> DataFrame:
        return self._table("files", feed.STATE, self._manifest())

    @property
    def graph(self) -> Graph:
        manifest = self._manifest()
        graph = Graph.of(self._table("triples", OWNED, manifest).select("s", "p", "o").distinct())
        graph.version = manifest["batch"]
        return graph

    def apply(self, batch: DataFrame, number: int) -> UpdateResult:
        """Take in the latest change of each file of a batch; unchanged contents are skipped."""
        began = time.perf_counter()
        manifest = self._manifest()
        self.batches += 1
        if manifest["batch"] >= number:
            return UpdateResult(seconds=time.perf_counter() - began)
        version = f"version={number}"
        base = f"{self.folder}/{version}"

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{base}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{base}/{name}")

        latest = written(feed.latest_by_file(feed.watched(batch)), "latest")
        state = self._table("files", feed.STATE, manifest, self._buckets_of(latest))
        changes = written(feed.changed(latest, state), "changes")
        if changes.isEmpty():
            return UpdateResult(seconds=time.perf_counter() - began)
        own = self._buckets_of(changes)
        new = written(extract.extract(self.contents(changes.where("event_type <> 'deleted'").select("file_path"))), "new")
        old, state = self._table("entities", ENTITY, manifest, own), self._table("files", feed.STATE, manifest, own)
        counted = feed.counts(old, changes, new).first()
        self._rewrite("entities", feed.upsert(old, changes, new), version, own, manifest)
        self._rewrite("files", feed.next_state(state, changes), version, own, manifest)
        entities = self._table("entities", ENTITY, manifest)
        files = written(lowering.touched(entities.unionByName(old), changes), "touched")
        touched = self._buckets_of(files)
        kept = self._table("triples", OWNED, manifest, touched).join(files, "file_path", "left_anti").select("file_path", "s", "p", "o")
        self._rewrite("triples", kept.unionByName(lowering.relower(entities, files)), version, touched, manifest)
        affected = files.count()
        manifest |= {"batch": number, "buckets": self.buckets}
        self.files.write(f"{self.folder}/latest", json.dumps(manifest))
        self.changed += 1
        return UpdateResult(**counted.asDict(), affected_files=affected, buckets_rewritten=len(touched | own), seconds=time.perf_counter() - began)

    def affected_by(self, changes: DataFrame, transitive: bool = False) -> DataFrame:
        """Files that a change touches: the changed ones and those that import them."""
        return feed.affected(changes, extract.module_imports(self.entities), transitive)

    def statistics(self) -> dict:
        """Batches seen and taken in, files and entities now."""
        return {"batches": self.batches, "changed": self.changed, "files": self.state.count(), "entities": self.entities.agg(F.count(F.lit(1))).first()[0]}

    def follow(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """Apply the micro-batches of a stream of changes."""
        return feed.run(stream, lambda batch, k: self.apply(batch, k), checkpoint, every)
