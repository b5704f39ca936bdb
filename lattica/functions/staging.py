"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; a local session that names none gets a folder of its own, a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + own)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers whose path lacks it."""
    root = str(_PACKAGE.parent)
    app = spark.sparkContext.applicationId
    if app in _shipped or os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lattica-"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def at_most(df: DataFrame, rows: int, size: int = 20 << 20) -> bool:
    """Whether ``df`` has no more than ``rows`` rows and ``size`` bytes of text, reading no more rows than needed to tell."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    width = reduce(Column.__add__, texts, F.lit(0)).cast("long")
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found["n"] <= rows and found["bytes"] <= size
