"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

The set of a document is cut by hash into parts, one more than the most values
in which two sets of its size band can differ at the wanted similarity; two
similar sets then agree in a whole part.  A tile is a size band with the
content of one part; documents of a tile, and tiles through their documents,
form groups, and only inside a group are pairs compared: hashed bitmap
signatures bound the overlap from above before exact sorted-array
intersection (:mod:`lattica.llm.components`).

Sets are held as sorted 64-bit hashes of their n-grams, and a set's class is a
64-bit hash of its values; equal sets are one class, so copies are never
expanded into pairs.

Defined cases: a text with fewer words than the n-gram has its whole sequence
as its one n-gram; a null text or one without words has the empty set and is
linked with nothing; rows that repeat an id count as rows of their own; a null
id never is a component's id while another one is there; a text of any length is
read whole, its bitmap having at most 8 KB; an empty table gives an empty
result; columns beside the id and the text may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import textscan
from lattica.llm.common import map_text, private, slices, stage
from lattica.llm.components import components, grouped, sketch, verified


GROWTH, SALTS = 1.3, 6


def bands(growth: float = GROWTH, most: int = 1 << 40) -> np.ndarray:
    """The largest size of each size band."""
    out, low = [], 1
    while low <= most:
        out.append(max(low, int(low * growth)))
        low = out[-1] + 1
    return np.array(out, dtype=np.int64)


_BANDS = bands()


def parts_of(top: int, percent: int) -> tuple[int, int]:
    """(parts, spare ones) for sets of at most ``top`` values.

    Similar sets differ in at most ``2 * top * (100 - percent) / (100 + percent)``
    values, so with one part more they agree in a whole part.  Empty parts
    agree too and say nothing; spare parts make up for twice as many of them
    as the smallest sets of the band are expected to have.
    """
    differ = 2 * top * (100 - percent) // (100 + percent)
    if not differ:
        return 1, 0
    fill = top * percent / 100 / GROWTH / (differ + 1)
    spare = 1 + int(2 * (differ + 1) * math.exp(-fill))
    return differ + 1 + spare, spare


def tile_keys(values: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a sorted set of 64-bit hashes.

    Only parts with a value give a tile.  A set that has more empty parts than
    are spare is cut again with another salt, and so is every set similar to
    it that has too many; after the last salt its empty parts give tiles too.
    """
    n = len(values)
    spread = textscan.mix(values, 11)
    out = []
    for band in range(int(np.searchsorted(_BANDS, n)), int(np.searchsorted(_BANDS, n * 100 // percent)) + 1):
        parts, spare = parts_of(int(_BANDS[band]), percent)
        for salt in range(SALTS):
            own, name = _cut(values, spread, parts, salt)
            empty = parts - len(name)
            if empty > spare and salt == SALTS - 1:
                rest = np.setdiff1d(np.arange(parts, dtype=np.uint64), name)
                own, name = np.concatenate([own, np.zeros(len(rest), np.uint64)]), np.concatenate([name, rest])
            with np.errstate(over="ignore"):
                out.append(textscan.mix(own + name * np.uint64(0x9FB21C651E98DF25) + np.uint64((band * SALTS + salt + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)))
            if empty <= spare:
                break
    return np.concatenate(out)


def _cut(values: np.ndarray, spread: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of each part that has some, and the parts' names."""
    if salt:
        values = textscan.mix(values, 20 + salt)
        order = np.argsort(values)
        values, spread = values[order], spread[order]
    with np.errstate(over="ignore"):
        part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        return np.add.reduceat(spread, first), part[first]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    starts, ends = textscan.runs(textscan.BLANK_WORDS[raw], offsets)
    words = textscan.span_hashes(raw, starts, ends, lower=True)
    grams = textscan.gram_hashes(words, width)
    bounds = textscan.per_text(starts, offsets)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        else:
            yield textscan.gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_class(values: np.ndarray) -> int:
    """The class of a set: equal sets have equal classes."""
    with np.errstate(over="ignore"):
        return int(textscan.mix(np.array([textscan.mix(values, 3).sum() + np.uint64(len(values))], dtype=np.uint64)).view(np.int64)[0])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) of each row; links need ``percent`` or more.

    component_id is the smallest id reachable over links, the row's own
    included.
    """
    rows = linked(docs, id_col, text_col, width, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, text_hash, n, component, least) of each row: its set's size, its component and the smallest id of that."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for first, last, raw, offsets in slices(batch, "text"):
            n, classes, tiles, sketches = [], [], [], []
            for values in shingle_sets(raw, offsets, width):
                own = set_class(values) if len(values) else None
                n.append(len(values))
                classes.append(own)
                fresh = own is not None and own not in seen
                tiles.append(tile_keys(values, percent).view(np.int64) if fresh else None)
                sketches.append(sketch(values) if fresh else None)
                seen.add(own)
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(tiles, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["id", "text_hash", "n", "node", "tiles", "bits"],
            )

    sets = map_text(hashed, f"id {kind}, text_hash long, n long, node long, tiles array<long>, bits binary", describe, ["id", "text", "text_hash"])
    sets = stage(spark, sets, "jaccard-sets")

    tiles = sets.where("tiles is not null").select(F.explode("tiles").alias("key"), "node")
    sketches = sets.where("tiles is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    groups = grouped(spark, tiles, "jaccard-groups", sketches, percent)
    one = sets.where("n > 0").groupBy("node").agg(F.min(F.struct("text_hash", "id", "n")).alias("one"))
    wanted = groups.join(one, "node").select("node", "grp", "one.*")
    wanted = stage(spark, wanted, "jaccard-wanted")
    sizes = wanted.groupBy("grp").agg(F.count(F.lit(1)).alias("grp_n"), F.sum("n").alias("grp_values"))
    # Written, so that the join has two plain sides and a long group can be split.
    sizes = stage(spark, sizes, "jaccard-sizes")
    wanted = wanted.join(sizes, "grp").select("grp", "grp_n", "grp_values", "node", "text_hash", F.col("id").alias("one_id"))

    def values_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes = batch.column("node").to_pylist()
        for first, last, raw, offsets in slices(batch, "text"):
            found = list(shingle_sets(raw, offsets, width))
            right = [k for k, values in enumerate(found) if len(values) and set_class(values) == nodes[first + k]]
            part = batch.slice(first, last - first).take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("grp", "grp_n", "grp_values", "node")), pa.array([found[k].tobytes() for k in right], pa.binary())],
                names=["grp", "grp_n", "grp_values", "node", "values"],
            )

    # Shuffled at every size, so that what is moved follows the input.
    texts = hashed.join(wanted.hint("merge"), (hashed["text_hash"] == wanted["text_hash"]) & hashed["id"].eqNullSafe(wanted["one_id"])).drop(wanted["text_hash"])
    members = map_text(texts, "grp long, grp_n long, grp_values long, node long, values binary", values_of, ["grp", "grp_n", "grp_values", "node", "text"])
    joined = components(spark, verified(members, percent), "jaccard-links")

    ids = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    placed = ids.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    placed = stage(spark, placed, "jaccard-placed")
    named = placed.groupBy("root").agg(F.min("least").alias("least"))
    named = stage(spark, placed.drop("least").join(named, "root").select("node", F.col("root").alias("component"), "least"), "jaccard-named")
    return sets.select("id", "text_hash", "n", "node").join(named, "node", "left").select("id", "text_hash", "n", "component", "least")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of its rows the smallest id, nulls last, then the smallest hash of the text.

    A row is told by its id and its text, so different texts under one id are
    judged apart; of rows that repeat both, one stays.  Rows without words are
    linked with nothing and all stay.
    """
    spark = docs.sparkSession
    columns = docs.columns
    found = stage(spark, linked(docs, id_col, text_col, width, percent), "jaccard-found")
    rows = found.where("n > 0").groupBy("component", "id", "text_hash").agg(F.count(F.lit(1)).alias("same"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "same")).alias("first")
    names = rows.groupBy("component").agg(first).select("first.id", "first.text_hash", "first.same")
    # Rows without words are kept whatever their number.
    bare = found.where("n = 0").select("id", "text_hash").distinct().withColumn("same", F.lit(1).cast("long"))
    keep_id, keep_hash, same = private(columns, "keep_id", "keep_hash", "same")
    kept = stage(spark, names.unionByName(bare).toDF(keep_id, keep_hash, same), "jaccard-kept")
    match = (F.xxhash64(docs[text_col]) == F.col(keep_hash)) & docs[id_col].eqNullSafe(F.col(keep_id))
    out = docs.join(kept.where(F.col(same) == 1).hint("shuffle_hash"), match).select(*columns)
    alike = kept.where(F.col(same) > 1)
    if alike.isEmpty():
        return out
    return out.unionByName(docs.join(alike, match).dropDuplicates([keep_hash, keep_id]).select(*columns))
