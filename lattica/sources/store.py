"""Snapshots of a graph: versioned folders and a pointer to the latest."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import TRIPLES, Graph
from lattica.operators import analytics, crud, paths
from lattica.plans.patterns import GraphPattern, match_property_graph
from lattica.sources import property_graph, rdf

VERTICES = "id string, name string, type string, location string, line_number int, attrs map<string,string>"
EDGES = "src string, dst string, relationship string, type string"
FORMATS = ("parquet", "nt", "turtle", "xml", "json-ld")


class _Files:
    """Small files through Hadoop's file system, so that any store works."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def fs(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.fs(name).exists(self.path(name))

    def write(self, name: str, text: str) -> None:
        """Replace a file in one step: write beside it, then rename."""
        fs, new = self.fs(name), name + ".new"
        out = fs.create(self.path(new), True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(self.path(name), False)
        if not fs.rename(self.path(new), self.path(name)):
            raise OSError(f"can't write {name}")

    def read(self, name: str) -> str:
        source = self.fs(name).open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def folders(self, name: str) -> list[tuple[str, int]]:
        """(name, time) of the folders inside one."""
        if not self.exists(name):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs(name).listStatus(self.path(name)) if s.isDirectory()]


@dataclass
class Store:
    """Triples with their snapshots.  One writer at a time; a reader sees whole snapshots only."""

    spark: SparkSession
    folder: str
    triples: DataFrame | None = None
    version: int = 0

    def __post_init__(self) -> None:
        self.files = _Files(self.spark)
        self.folder = self.folder.rstrip("/")
        if self.triples is None:
            self.triples = self.spark.createDataFrame([], TRIPLES)

    @property
    def graph(self) -> Graph:
        graph = Graph.of(self.triples)
        graph.version = self.version
        return graph

    def _set(self, triples: DataFrame) -> None:
        self.triples = triples
        self.version += 1

    def add(self, triples: DataFrame) -> None:
        """Merge; what is there stays."""
        self._set(crud.merge(self.triples, triples))

    def update_entity(self, uri: str, values: dict[str, object]) -> None:
        self._set(crud.update(self.triples, uri, values))

    def delete_entity(self, uri: str) -> None:
        self._set(crud.delete(self.triples, self.spark.createDataFrame([(uri,)], "uri string")))

    def save(self, kind: str = "parquet", name: str | None = None) -> str:
        """Write a snapshot and point to it; the snapshot's folder."""
        if kind not in FORMATS:
            raise ValueError(f"unknown format {kind!r}")
        created = datetime.now(timezone.utc)
        target = f"{self.folder}/snapshot={name or created.strftime('%Y%m%d_%H%M%S')}"
        if kind == "parquet":
            self.triples.repartition("p").sortWithinPartitions("p", "s").write.mode("overwrite").parquet(f"{target}/triples")
            saved = self.spark.read.schema(TRIPLES).parquet(f"{target}/triples")
            # The saved table has no lineage, and the work goes on from it.
            self.triples = saved
        else:
            rdf.write(self.triples, f"{target}/triples", kind)
            saved = self.triples
        meta = {"created": created.isoformat(), "format": kind, "triples_count": saved.count(), "namespaces": [r[0] for r in namespaces(saved).collect()]}
        self.files.write(f"{target}/metadata.json", json.dumps(meta))
        self.files.write(f"{self.folder}/latest", target.rsplit("/", 1)[-1])
        return target

    def metadata(self, snapshot: str | None = None) -> dict:
        return json.loads(self.files.read(f"{snapshot or self.latest()}/metadata.json"))

    def latest(self) -> str | None:
        name = f"{self.folder}/latest"
        return f"{self.folder}/{self.files.read(name).strip()}" if self.files.exists(name) else None

    def load(self, snapshot: str | None = None) -> bool:
        """Read a snapshot, the latest by default; without one the store is empty."""
        target = snapshot or self.latest()
        if target is None or not self.files.exists(target):
            self._set(self.spark.createDataFrame([], TRIPLES))
            return False
        kind = self.metadata(target)["format"]
        at = f"{target}/triples"
        self._set(self.spark.read.schema(TRIPLES).parquet(at) if kind == "parquet" else rdf.read(self.spark, at, kind))
        return True

    def statistics(self) -> dict:
        """Counts of triples and types, and what snapshots there are."""
        found = self.files.folders(self.folder)
        snapshots = [(name, at) for name, at in found if name.startswith("snapshot=")]
        return {
            "backend": "triples",
            "path": self.folder,
            "triples": self.triples.count(),
            "types": {r["label"]: r["n"] for r in self.graph.types().collect()},
            "backup_count": len(snapshots),
            "latest_backup": max(snapshots, key=lambda s: s[1])[0] if snapshots else None,
        }


def namespaces(triples: DataFrame) -> DataFrame:
    """Namespaces of the predicates; there are few of them in any graph."""
    return triples.select(F.regexp_extract("p", r"^<(.*[/#])[^/#]*>$", 1).alias("namespace")).distinct().orderBy("namespace")


class PropertyStore:
    """Vertices and edges with their snapshots; one writer at a time."""

    FORMATS = ("parquet", "graphml", "gexf")

    def __init__(self, spark: SparkSession, folder: str, vertices: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark)
        self.vertices = vertices if vertices is not None else spark.createDataFrame([], VERTICES)
        self.edges = edges if edges is not None else spark.createDataFrame([], EDGES)
        self.version = 0

    def _set(self, vertices: DataFrame, edges: DataFrame) -> None:
        self.vertices, self.edges = vertices, edges
        self.version += 1

    def add(self, vertices: DataFrame, edges: DataFrame) -> None:
        """Add vertices that are not there yet, and edges; parallel edges stay."""
        new = vertices.join(self.vertices.select("id"), "id", "left_anti")
        self._set(self.vertices.unionByName(new, allowMissingColumns=True), self.edges.unionByName(edges, allowMissingColumns=True))

    def update_entity(self, uri: str, values: dict[str, str]) -> None:
        self._set(crud.update_vertex(self.vertices, uri, values), self.edges)

    def delete_entity(self, uri: str) -> None:
        self._set(*crud.delete_vertex(self.vertices, self.edges, uri))

    def save(self, kind: str = "parquet", name: str | None = None) -> str:
        """Write a snapshot and point to it."""
        if kind not in self.FORMATS:
            raise ValueError(f"unknown format {kind!r}")
        created = datetime.now(timezone.utc)
        target = f"{self.folder}/snapshot={name or created.strftime('%Y%m%d_%H%M%S')}"
        if kind == "parquet":
            self.vertices.write.mode("overwrite").parquet(f"{target}/vertices")
            self.edges.write.mode("overwrite").parquet(f"{target}/edges")
        else:
            lines = property_graph.graphml(self.vertices.drop("attrs"), self.edges) if kind == "graphml" else property_graph.gexf(self.vertices, self.edges)
            property_graph.write_document(lines, f"{target}/graph")
        meta = {"created": created.isoformat(), "format": kind, "nodes": self.vertices.count(), "edges": self.edges.count()}
        self.files.write(f"{target}/metadata.json", json.dumps(meta))
        self.files.write(f"{self.folder}/latest", target.rsplit("/", 1)[-1])
        return target

    def load(self, snapshot: str | None = None) -> bool:
        """Read a snapshot, the latest by default; without one the store is empty."""
        pointer = f"{self.folder}/latest"
        target = snapshot or (f"{self.folder}/{self.files.read(pointer).strip()}" if self.files.exists(pointer) else None)
        if target is None or not self.files.exists(target):
            self._set(self.spark.createDataFrame([], VERTICES), self.spark.createDataFrame([], EDGES))
            return False
        kind = json.loads(self.files.read(f"{target}/metadata.json"))["format"]
        if kind == "parquet":
            self._set(self.spark.read.parquet(f"{target}/vertices"), self.spark.read.parquet(f"{target}/edges"))
        else:
            read = property_graph.read_graphml if kind == "graphml" else property_graph.read_gexf
            vertices, edges = read(self.spark, f"{target}/graph")
            name = F.col("attrs")["name"] if kind == "graphml" else F.col("name")
            own = [name.alias("name"), *(F.col("attrs")[c].alias(c) for c in ("type", "location"))]
            label = F.col("attrs")["relationship"] if kind == "graphml" else F.col("relationship")
            self._set(vertices.select("id", *own, F.col("attrs")["line_number"].cast("int").alias("line_number"), "attrs"), edges.select("src", "dst", label.alias("relationship"), F.col("attrs")["type"].alias("type")))
        return True

    def match(self, pattern: GraphPattern) -> DataFrame:
        return match_property_graph(self.vertices, self.edges, pattern)

    def context(self, uri: str, depth: int = 2) -> DataFrame:
        """Vertices within ``depth`` hops along the edges, with a shortest path to each."""
        found = paths.neighbors(self.edges, uri, depth)
        return found.join(self.vertices.withColumnRenamed("id", "node"), "node", "left")

    def statistics(self) -> dict:
        """Counts, density, clustering and types."""
        row = analytics.statistics(self.edges, self.vertices).first()
        types = {r["type"]: r["n"] for r in analytics.type_counts(self.vertices).collect()}
        return {"backend": "property", "path": self.folder} | row.asDict() | {"types": types}

    def export(self, kind: str = "json") -> DataFrame:
        """Lines (place, value) for drawing: node-link JSON objects, GraphML or DOT."""
        if kind == "graphml":
            return property_graph.graphml(self.vertices.drop("attrs"), self.edges)
        if kind == "dot":
            return property_graph.dot(self.vertices, self.edges)
        if kind != "json":
            raise ValueError(f"unknown format {kind!r}")
        nodes, links = property_graph.node_link(self.vertices, self.edges)
        return nodes.select(F.lit(1).alias("place"), "value").unionByName(links.select(F.lit(2).alias("place"), "value"))
