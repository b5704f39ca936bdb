"""Benchmark decontamination by winnowing.

A word span is hit when it is one of an item's windows: ``WINDOW`` consecutive
words, or all words of a shorter item.  Winnowing keeps, of every ``SPAN``
consecutive hashes of ``GRAM`` words, the smallest; because
``GRAM + SPAN - 1 == WINDOW``, every occurrence of a window holds a kept hash,
and it is the same one on both sides.  Windows of short items have no such
guarantee and are found by a hash of all their words.

Items become a table of fingerprints, each with the words around it.  Documents
are read once; of their fingerprints those that a bitmap of the items' allows
(its size has a bound) go on with the words around them, are joined with the
items' by hash, and are extended word by word to both sides: a run of a whole
window is a hit.  So neither the driver nor a worker holds the items, and a
passage that many documents share is only a long key of a join of written
tables, which can be split.

Defined cases: a null or empty text, or one without words, has no words and no
hits; items without words are ignored; an item id that stands on several rows
counts once, and an item without an id marks words but is not counted or named;
rows that repeat an id or a text give a row each; a text or item of any length
is read whole; an empty items table leaves every document clean and an empty
documents table gives an empty result; a kept column that has the name of a
result gives way to it, and other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textscan
from lattica.llm.common import map_text, slices, stage

WINDOW, GRAM, SPAN = 13, 8, 6
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of the bitmap for each fingerprint, and its least and greatest size as powers of two (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Rows of a small table that is broadcast; a larger one is shuffled.
FEW = 100_000
_FOUND = "at long, width int, hash long, left array<string>, right array<string>"
_ARROW = pa.struct([("at", pa.int64()), ("width", pa.int32()), ("hash", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``width`` consecutive values."""
    count = len(values) - width + 1
    out = values[:count].copy()
    for k in range(1, width):
        pick(out, values[k : k + count], out=out)
    return out


def winnow(grams: np.ndarray) -> np.ndarray:
    """Which hashes are the smallest of some ``SPAN`` consecutive ones."""
    if len(grams) < SPAN:
        return np.ones(len(grams), dtype=bool)
    low = _sliding(grams, SPAN, np.minimum)
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)])
    return _sliding(padded, SPAN, np.maximum) == grams


class Words:
    """The words of a run of texts and their hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.starts, self.ends = textscan.runs(textscan.ALNUM_WORDS[raw], offsets)
        self.bounds = textscan.per_text(self.starts, offsets)
        self.hashes = textscan.span_hashes(raw, self.starts, self.ends, lower=True)
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the fingerprints of all texts with a whole window."""
        grams = textscan.gram_hashes(self.hashes, GRAM)
        apart = self.text_of[: len(grams)] != self.text_of[GRAM - 1 :][: len(grams)]
        grams[apart] = _NONE
        at = np.flatnonzero(winnow(grams) & ~apart)
        return at, grams[at]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of ``width`` words that lie in one text."""
        grams = textscan.gram_hashes(self.hashes, width)
        at = np.flatnonzero(self.text_of[: len(grams)] == self.text_of[width - 1 :][: len(grams)])
        return at, grams[at]

    def around(self, at: int, width: int, value: int) -> tuple:
        """A fingerprint with the words before it, nearest first, and those from it on."""
        text = int(self.text_of[at])
        first, last = int(self.bounds[text]), int(self.bounds[text + 1])
        before = range(at - 1, max(first, at - SPAN + 1) - 1, -1) if width == WINDOW else ()
        return at - first, width, value, [self.word(k) for k in before], [self.word(k) for k in range(at, min(last, at + width))]

    def word(self, k: int) -> str:
        return self.raw[self.starts[k] : self.ends[k]].tobytes().lower().decode("utf-8", "replace")


def fingerprints(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, at, width, hash, left, right) of every item's fingerprints, ``left`` and ``right`` being words around them."""

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, raw, offsets in slices(batch, "text"):
            words = Words(raw, offsets)
            size = np.diff(words.bounds)
            rows = [(int(words.text_of[k]), words.around(k, WINDOW, h)) for k, h in zip(*(x.tolist() for x in _signed(*words.kept())), strict=True) if size[words.text_of[k]] >= WINDOW]
            for text in np.flatnonzero((size > 0) & (size < WINDOW)).tolist():
                at = int(words.bounds[text])
                value = textscan.gram_hashes(words.hashes[at : at + size[text]], int(size[text])).view(np.int64)[0]
                rows.append((text, words.around(at, int(size[text]), int(value))))
            ids = batch.column("item").slice(first, last - first)
            columns = list(zip(*(found for _, found in rows), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([text for text, _ in rows], pa.int64())), *(pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True))], names=["item", *(f.name for f in _ARROW)])

    own = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_text(own, f"item string, {_FOUND}", body, ["item", "text"])


def _signed(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at, hashes.view(np.int64)


class Bitmap:
    """Which hashes may be there: two bits for each, in a table of a bounded size."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def allows(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for shift in (0, 32):
            place = (hashes >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, found: DataFrame) -> Bitmap:
        """The bitmap of the hashes of ``found``, put together by partial aggregates; what is collected has the bitmap's bound."""
        n = found.agg(F.approx_count_distinct("hash")).first()[0]
        bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
        place = F.explode(F.array(*[F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit(bits - 1)) for shift in (0, 32)]))
        places = found.select(place.alias("place"))
        rows = places.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        words = np.zeros(bits >> 6, dtype=np.int64)
        got = rows.toArrow()
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        return cls(bits, words.view(np.uint64))


def survivors(docs: DataFrame, keep: list[str], bitmap: Bitmap, widths: list[int], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``n_words`` and ``found``: the fingerprints of each text that the bitmap allows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, raw, offsets in slices(batch, text_col):
            words = Words(raw, offsets)
            found: dict[int, list[tuple]] = {}
            for width in widths:
                at, hashes = words.kept() if width == WINDOW else words.windows(width)
                hit = shared.value.allows(hashes)
                for k, value in zip(at[hit].tolist(), hashes[hit].view(np.int64).tolist(), strict=True):
                    found.setdefault(int(words.text_of[k]), []).append(words.around(k, width, value))
            rows = batch.slice(first, last - first).select(keep)
            each = [[dict(zip(("at", "width", "hash", "left", "right"), x, strict=True)) for x in found.get(k, ())] for k in range(last - first)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(words.bounds), pa.int64()), pa.array(each, pa.list_(_ARROW))], names=[*keep, "n_words", "found"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_text(docs, f"{kept}, n_words long, found array<struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>>", body, list(dict.fromkeys([*keep, text_col])))


def _same(a: str, b: str) -> Column:
    """How many words of two columns agree from the first on."""
    agree = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(agree, F.lit(False))
    return F.when(differ == 0, F.size(agree)).otherwise(differ - 1).cast("int")


def hits(spark: SparkSession, found: DataFrame, prints: DataFrame) -> DataFrame:
    """(rid, item, start, end) of the runs of whole windows, from survivors (rid, at, width, hash, left, right)."""
    own = prints.select("item", "width", "hash", F.col("left").alias("item_left"), F.col("right").alias("item_right"))
    if own.limit(FEW + 1).count() <= FEW:
        own = F.broadcast(own)
    met = found.join(own, ["width", "hash"]).withColumn("before", _same("left", "item_left")).withColumn("after", _same("right", "item_right"))
    # The run reaches ``before`` words back and ``after`` words on from the fingerprint.
    met = met.where((F.col("after") >= F.least(F.col("width"), F.lit(GRAM))) & (F.col("before") + F.col("after") >= F.col("width")))
    return met.select("rid", "item", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))


def _covered(spans: Column) -> Column:
    """How many places sorted spans (start, end) cover together."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(done: Column, span: Column) -> Column:
        grow = F.greatest(span["end"] - F.greatest(span["start"], done["to"]), F.lit(0))
        return F.struct((done["n"] + grow).cast("long").alias("n"), F.greatest(done["to"], span["end"]).cast("long").alias("to"))

    return F.aggregate(spans, none, step, lambda done: done["n"])


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    ratio: int = 20,
) -> DataFrame:
    """The ``keep`` columns of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when it is hit and at least one in ``ratio`` of
    its words is.
    """
    spark = docs.sparkSession
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    prints = stage(spark, fingerprints(benchmark, item_col, item_text_col), "benchmark-prints")
    widths = sorted(r["width"] for r in prints.select("width").distinct().collect())
    rows = survivors(own, [f"k{i}" for i in range(len(keep))], Bitmap.of(prints), widths)
    # Written, so that the number of a row is the same in both uses.
    rows = stage(spark, rows.withColumn("rid", F.monotonically_increasing_id()), "benchmark-rows")
    met = stage(spark, hits(spark, rows.select("rid", F.explode("found").alias("f")).select("rid", "f.*"), prints), "benchmark-hits")
    spans = met.select("rid", "start", "end").distinct().groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = met.select("rid", "item").distinct().groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    out = rows.drop("found").join(spans, "rid", "left").join(items, "rid", "left").withColumn("n_hit", n_hit)
    results = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in results],
        "n_words",
        "n_hit",
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ratio: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones.

    Texts decide, so contaminated texts are told by their MD5; the texts
    themselves are not shuffled as long as those are few.
    """
    spark = docs.sparkSession
    named = docs.select(F.md5(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    found = scan(named, benchmark, ["text_key"], "text", item_col, item_text_col, ratio)
    dirty = stage(spark, found.where("contaminated").select("text_key").distinct(), "benchmark-dirty")
    few = dirty.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(dirty) if few else dirty, F.md5(docs[text_col]) == dirty["text_key"], "left_anti")
