"""Fuzzy line dedup by MinHash.

A line (one with a word in it) is the set of its character shingles, lower
case and without outer white space.  Its signature comes from one hash of each
shingle: the smallest hash of each of ``BANDS * ROWS`` equal bins, empty bins
filled from others in a fixed order.  Lines that agree in all rows of a band
meet in its bucket; of a bucket's lines those whose sizes and signature bits
allow the similarity are compared by exact Jaccard similarity, and only
verified links make components, of which one line stays: the first by id, then
by place in the text.

At the default similarity of 0.8 a pair meets in some band with probability
``1 - (1 - 0.8 ** ROWS) ** BANDS`` or 0.99.  Equal lines are one node
throughout, so copies are never expanded into pairs.

Defined cases: a null text counts as empty; a text without words has no lines;
null ids come last; rows that repeat both id and text count as one document,
so each keeps the same lines; a document that had lines and loses all of them
is dropped by :func:`apply`; texts and lines of any length are read whole; an
empty table gives an empty result; columns beside the id and the text may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import components as grouping
from lattica.llm import textscan
from lattica.llm.common import map_text, private, ship, slices, stage, text_column
from lattica.llm.components import components, divided, in_blocks, labelled, long_tiles, verified

#: The shingle length is a power of two; at 4, lines of 39 characters and more that differ in one are linked.
SHINGLE, BANDS, ROWS = 4, 12, 5
_BINS = BANDS * ROWS
_HASH_BITS = 48
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << _HASH_BITS) - 1)
#: Bytes of text handled at once: small enough for a core's cache.
_CHUNK = 1 << 17
_lower: list[np.ndarray] = []
_order: list[np.ndarray] = []


def _lowered(text: bytes) -> np.ndarray:
    """Code points of a UTF-8 text, in lower case below 0x3000."""
    if not _lower:
        _lower.append(np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x3000)], dtype=np.uint64))
    codes = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _lower[0][np.minimum(codes, 0x2FFF)]
    high = codes >= 0x3000
    if high.any():
        out[high] = codes[high]
    return out


class LineSets:
    """The lines of a run of texts as sorted shingle sets."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE):
        self.width = width
        first, last = line_bounds(raw, offsets)
        self.bounds = textscan.per_text(first, offsets)
        self.count = len(first)
        self.nodes = np.zeros(self.count, dtype=np.uint64)
        self.sizes = np.zeros(self.count, dtype=np.int64)
        self.values: list[np.ndarray] = []
        self.value_bounds: list[np.ndarray] = []
        if not self.count:
            return
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = _lowered(raw.tobytes())
        begin, end = np.searchsorted(lead, first), np.searchsorted(lead, last)
        rolled = _rolling(codes, width)
        for lo in range(0, self.count, 1 << 16):
            hi = min(self.count, lo + (1 << 16))
            self._fill(codes, rolled, begin[lo:hi], end[lo:hi], lo)

    def _fill(self, codes: np.ndarray, rolled: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: int) -> None:
        width = self.width
        full = np.flatnonzero(end - begin >= width)
        edge = np.zeros(len(codes) + 1, dtype=np.int8)
        edge[begin[full]] = 1
        edge[end[full] - width + 1] -= 1
        inside = np.cumsum(edge[: len(rolled)], dtype=np.int8).astype(bool)
        line = np.repeat(full.astype(np.uint64), end[full] - begin[full] - width + 1)
        keys = (line << np.uint64(_HASH_BITS)) | (rolled[inside] & _LOW)
        short = np.flatnonzero(end - begin < width)
        if len(short):
            own = [(k << _HASH_BITS) | int(_short(codes[begin[k] : end[k]]) & _LOW) for k in short.tolist()]
            keys = np.concatenate([keys, np.array(own, dtype=np.uint64)])
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        line = (keys >> np.uint64(_HASH_BITS)).astype(np.int64)
        values = keys & _LOW
        bounds = np.searchsorted(line, np.arange(len(begin) + 1))
        self.sizes[lo : lo + len(begin)] = np.diff(bounds)
        with np.errstate(over="ignore"):
            self.nodes[lo : lo + len(begin)] = textscan.mix(np.add.reduceat(values, bounds[:-1]) + (np.diff(bounds).astype(np.uint64) << np.uint64(_HASH_BITS)))
        self.values.append(values)
        self.value_bounds.append(bounds)

    def bands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of band hashes for each line, and two words of signature bits."""
        out = [band_hashes(signatures(values, bounds)) for values, bounds in zip(self.values, self.value_bounds, strict=True)]
        none = np.zeros(0, np.uint64)
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros((0, BANDS), np.uint64), none, none)


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the words of each line that has one."""
    starts, ends = textscan.runs(textscan.BLANK_WORDS[raw], offsets)
    breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
    cut = np.unique(np.searchsorted(starts, breaks))
    cut = cut[cut < len(starts)]
    return starts[cut], ends[np.concatenate([cut[1:], [len(starts)]]) - 1] if len(cut) else ends[:0]


def _rolling(codes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles from each place, by doubling their length."""
    out, half = codes, 1
    with np.errstate(over="ignore"):
        while half < width:
            if len(out) <= half:
                return np.zeros(0, np.uint64)
            out = out[:-half] * np.uint64(pow(0xD6E8FEB86659FD93, half, 1 << 64)) + out[half:]
            half *= 2
    return textscan.mix(out, width)


def _short(codes: np.ndarray) -> np.uint64:
    return textscan.gram_hashes(codes, len(codes))[0]


def line_values(lines: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each line, given without outer white space."""
    offsets = np.concatenate([[0], np.cumsum(np.array([len(line) for line in lines], dtype=np.int64))])
    raw, out, first = np.frombuffer(b"".join(lines), dtype=np.uint8), [], 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, side="right")) - 1)
        # Lines without a word take no part, so each line given is one.
        sets = LineSets(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
        out += [own[a:b] for own, bounds in zip(sets.values, sets.value_bounds, strict=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        first = last
    return out


def _sources() -> np.ndarray:
    """The bins that an empty bin is filled from, one column for each bin: a fixed sequence without its repetitions."""
    if not _order:
        spot = np.arange(_BINS, dtype=np.uint64)
        order, seen, attempt = [[] for _ in range(_BINS)], 0, 0
        while seen < _BINS * _BINS:
            attempt += 1
            for own, source in zip(order, (textscan.mix(spot, attempt) % np.uint64(_BINS)).tolist(), strict=True):
                if source not in own:
                    own.append(source)
                    seen += 1
        _order.append(np.array(order).T.copy())
    return _order[0]


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, for sorted sets ``values[bounds[i]:bounds[i + 1]]``."""
    n = len(bounds) - 1
    line = np.repeat(np.arange(n), np.diff(bounds))
    spot = (((values >> np.uint64(16)) * np.uint64(_BINS)) >> np.uint64(_HASH_BITS - 16)).astype(np.int64)
    cell = line * _BINS + spot
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    out = np.full(n * _BINS, _EMPTY, dtype=np.uint64)
    out[cell[first]] = values[first]
    table = out.reshape(n, _BINS)
    # A single value stands in all bins.
    full = np.bincount(line[first], minlength=n)
    alone = np.flatnonzero(full == 1)
    table[alone] = table[alone].min(axis=1)[:, None]
    empty = np.flatnonzero(out == _EMPTY)
    sparse, order = out.copy(), _sources()
    for turn in range(_BINS):
        if not len(empty):
            break
        spot = empty % _BINS
        found = sparse[empty - spot + order[turn][spot]]
        hit = found != _EMPTY
        out[empty[hit]] = found[hit]
        empty = empty[~hit]
    return table


def band_hashes(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One hash for each band of ``ROWS`` columns; and two bits of every column, as two words."""
    mixed = textscan.mix(signature, 5)
    places = np.uint64(1) << np.arange(_BINS, dtype=np.uint64)
    low, high = (((mixed >> np.uint64(k)) & np.uint64(1)) @ places for k in (20, 21))
    parts = mixed.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = parts[:, :, 0].copy()
        for k in range(1, ROWS):
            out = out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k]
        return textscan.mix(out + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)), low, high


def most_unlike(n: np.ndarray, percent: int) -> np.ndarray:
    """How many columns of two signatures may show different bits when the smaller set has ``n`` values.

    Columns of sets similar at ``percent`` differ with probability
    ``3 / 4 * (1 - percent / 100)``; the bound lies 4.5 deviations above that,
    by the columns that hold a value of their own.
    """
    p = 0.75 * (1 - percent / 100)
    own = np.maximum(_BINS * -np.expm1(-n / _BINS), 1)
    return _BINS * (p + 4.5 * np.sqrt(p * (1 - p) / own))


def alike(rows: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of ``rows`` (n, low, high) may be similar, by size and by signature bits."""
    n, low, high = rows
    least = np.minimum(n[a], n[b]).astype(np.int64)
    fit = least * 100 >= percent * np.maximum(n[a], n[b]).astype(np.int64)
    return fit & (np.bitwise_count((low[a] ^ low[b]) | (high[a] ^ high[b])) <= most_unlike(least, percent))


#: Rows of a band's bucket that are compared where they lie; longer buckets are dealt in blocks.
_BUCKET = 4096
#: A line's record has node, n, low, high and its bands' keys; of a row in a bucket the key, node, low, high and n pass on, in 32-bit words.
_RECORD, _ROW = 4 + BANDS, 9
#: Records that are dealt at once, and into how many pieces at least; a worker goes through a piece's buckets in memory.
_DEALT, _PIECES = 1 << 16, 1024
#: Lines are short, so their blocks hold more rows than others, and each line is copied to fewer of them.
_DEALING = {"block": 256, "spread": 8, "block_rows": 4096}


def _records(tiles: pa.Array) -> np.ndarray:
    """The records of a column that :func:`mark` packed."""
    if not len(tiles):
        return np.zeros((0, _RECORD), np.int64)
    width = np.int64 if pa.types.is_large_binary(tiles.type) else np.int32
    offsets = np.frombuffer(tiles.buffers()[1], dtype=width)[tiles.offset : tiles.offset + len(tiles) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros((0, _RECORD), np.int64)
    return np.frombuffer(tiles.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.int64).reshape(-1, _RECORD)


def _in_pieces(records: np.ndarray, pieces: int, without: np.ndarray) -> pa.RecordBatch:
    """(piece, rows): the rows of the records' buckets as one binary for each piece, but those of the sorted keys ``without``."""
    records = records[np.unique(records[:, 0], return_index=True)[1]]
    keys = records[:, 4:].ravel()
    piece = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.min_scalar_type(pieces))
    order = np.argsort(piece, kind="stable")
    if len(without):
        order = order[~_among(keys[order], without)]
    fixed = np.empty((len(records), _ROW - 2), np.uint32)
    fixed[:, :6] = np.ascontiguousarray(records[:, [0, 2, 3]]).view(np.uint32)
    fixed[:, 6] = records[:, 1]
    rows = np.empty((len(order), _ROW), np.uint32)
    rows[:, :2] = keys[order].view(np.uint32).reshape(-1, 2)
    rows[:, 2:] = fixed[order // BANDS]
    counts = np.bincount(piece[order], minlength=1)
    some = np.flatnonzero(counts)
    bounds = np.concatenate([[0], np.cumsum(counts[some])]) * rows.itemsize * _ROW
    packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), packed], names=["piece", "rows"])


def _met(held: list[np.ndarray]) -> np.ndarray:
    """(key, node, n, low, high) as rows of an array, in order, of the rows of a piece that are not alone in their bucket."""
    rows = np.concatenate(held)
    keys = np.ascontiguousarray(rows[:, :2]).view(np.int64).ravel()
    order = np.argsort(keys)
    keys = keys[order]
    more = np.zeros(len(keys) + 1, dtype=bool)
    more[1:-1] = keys[1:] == keys[:-1]
    some = more[:-1] | more[1:]
    keys, rows = keys[some], rows[order[some]]
    node, low, high = np.ascontiguousarray(rows[:, 2:8]).view(np.int64).T
    return np.stack([keys, node, rows[:, 8].astype(np.int64), low, high])[:, np.lexsort((node, keys))]


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among the sorted, not empty ``some``."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def families(spark: SparkSession, lines: DataFrame, percent: int) -> DataFrame:
    """(grp, node): lines of one bucket (key) that similar sizes and signatures tie together, from packed records (tiles).

    Groups are found inside each bucket, so chance meetings in other bands
    never chain them into larger ones, and a family found by several bands is
    one group.  Buckets are dealt to pieces by their key and gone through in
    arrays; one with more than ``_BUCKET`` rows passes on to be dealt in
    blocks, as do the longest, which never lie in one task.
    """
    ship(spark)
    packed = lines.select("tiles")
    share, names = grouping.SHARE, ["key", "node", "n", "low", "high"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = parts * -(-_PIECES // parts)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _records(batch.column(0))
            own = own[textscan.mix(own[:, 0].view(np.uint64), 13) % np.uint64(share) == 0] if own.size else own
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 4:].ravel()), pa.array(np.repeat(own[:, 0], BANDS))], names=names[:2])

    keys = long_tiles(spark, packed.mapInArrow(sampled, "key long, node long"), "lines", whole=False)
    # At most MOST_LONG keys.
    without = np.sort(np.array([] if keys is None else [r["key"] for r in keys.collect()], dtype=np.int64))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _records(batch.column(0))
            at, band = np.nonzero(_among(own[:, 4:], without))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[at, 4 + band], *own[at, :4].T)], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(_records(batch.column(0)))
            count += len(held[-1])
            if count >= _DEALT:
                own = np.concatenate(held)
                for first in range(0, count - _DEALT + 1, _DEALT):
                    yield _in_pieces(own[first : first + _DEALT], pieces, without)
                held = [own[first + _DEALT :]]
                count = len(held[0])
        if count:
            yield _in_pieces(np.concatenate(held), pieces, without)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, []
        for batch in batches:
            for at, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != piece and held:
                    yield as_batch(*settled(_met(held)))
                    held = []
                piece = at
                held.append(np.frombuffer(rows.as_buffer(), dtype=np.uint32).reshape(-1, _ROW))
        if held:
            yield as_batch(*settled(_met(held)))

    def settled(rows: np.ndarray) -> tuple[list, list]:
        """Families of whole buckets, and rows of long ones."""
        if not rows.shape[1]:
            return [], []
        fresh = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
        rows = rows[:, fresh]
        starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        counts = np.diff(np.concatenate([starts, [rows.shape[1]]]))
        long = counts > _BUCKET
        out = [rows[:, np.repeat(long, counts)]] if long.any() else []
        rows = rows[:, np.repeat(~long & (counts > 1), counts)]
        if not rows.shape[1]:
            return [], out
        views = rows[2], rows[3].view(np.uint64), rows[4].view(np.uint64)
        ends = np.concatenate([np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, [rows.shape[1]]])
        left = ends[np.searchsorted(ends, np.arange(rows.shape[1]), side="right")] - np.arange(rows.shape[1])
        label, pairs, step, ahead = np.arange(rows.shape[1]), [], 1, np.arange(rows.shape[1])
        while len(ahead := ahead[left[ahead] > step]):
            # What is tied already is not looked at again.
            a = ahead[label[ahead] != label[ahead + step]]
            a = a[alike(views, a, a + step, percent)]
            pairs.append((a, a + step))
            if step & (step - 1) == 0 or step % 64 == 0:
                label, pairs = joined(label, pairs), []
            step += 1
        label = joined(label, pairs)
        members = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        if not len(members):
            return [], out
        name = np.zeros(rows.shape[1], np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(name, label[members], textscan.mix(rows[1, members].view(np.uint64), 9))
        return [(textscan.mix(name[label[members]]).view(np.int64), rows[1, members])], out

    def joined(label: np.ndarray, pairs: list) -> np.ndarray:
        a, b = (label[np.concatenate(x)] for x in zip(*pairs, strict=True)) if pairs else (label[:0], label[:0])
        return labelled(len(label), a, b)[label]

    def as_batch(found: list, long: list) -> pa.RecordBatch:
        grp = [*(g for g, _ in found), *(x[0] for x in long)]
        node = [*(m for _, m in found), *(x[1] for x in long)]
        none = [np.zeros(len(g), np.int64) for g, _ in found]
        more = [[*none, *(x[k] for x in long)] for k in (2, 3, 4)]
        flags = [*(np.zeros(len(g), bool) for g, _ in found), *(np.ones(x.shape[1], bool) for x in long)]
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (grp, node, *more)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.concatenate(flags) if flags else [], pa.bool_())], names=[*names, "long"])

    dealt = packed.mapInArrow(deal, "piece int, rows binary").repartitionById(parts, F.col("piece") % parts).sortWithinPartitions("piece")
    done = stage(spark, dealt.mapInArrow(work, "key long, node long, n long, low long, high long, long boolean"), "lines-families")
    rest = done.where("long").select(*names).distinct()
    rest = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    if keys is not None:
        _, hot = divided(packed.mapInArrow(longest, "key long, node long, n long, low long, high long"), keys)
        rest = rest.unionByName(hot.select(*names, "size"))

    def settle(cross: bool, rows: list[tuple]) -> list[tuple[int, int]]:
        own, node, *views = (np.array(c) for c in zip(*rows, strict=True))
        views = views[0], views[1].view(np.uint64), views[2].view(np.uint64)
        tied = np.zeros(len(node), dtype=bool)
        # Every row against the one ``step`` places on; a node that has a partner belongs.
        for step in range(1, len(node)):
            # Pairs with a row that is not tied yet: fewer the more are.
            free = np.flatnonzero(~tied)
            if not len(free):
                break
            a = np.union1d(free[free < len(node) - step], free[free >= step] - step)
            a = a[own[a] != own[a + step]] if cross else a
            a = a[alike(views, a, a + step, percent)]
            tied[a] = tied[a + step] = True
        return [(n, n) for n in node[tied].tolist()]

    rest = rest.where("size > 1").select(F.col("key").alias("grp"), F.col("size").alias("grp_n"), "node", "n", "low", "high")
    dealt = in_blocks(rest, F.col("grp_n"), F.lit(0), settle, **_DEALING)
    dealt = dealt.select("grp", F.col("a").alias("node"))
    return done.where("not long").select(F.col("key").alias("grp"), "node").unionByName(dealt).distinct()


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """(id, text_hash, n_lines, removed) of each row: ``removed`` holds the numbers of the lines that go.

    Lines are numbered from 0 among those with a word; ``width`` is the shingle
    length, a power of two.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for first, last, raw, offsets in slices(batch, "text", _CHUNK):
            sets = LineSets(raw, offsets, width)
            nodes = sets.nodes.view(np.int64)
            fresh = np.zeros(sets.count, dtype=bool)
            fresh[np.unique(nodes, return_index=True)[1]] = True
            fresh &= np.array([n not in seen for n in nodes.tolist()], dtype=bool)
            seen.update(nodes[fresh].tolist())
            keys, low, high = (x.view(np.int64)[fresh] for x in sets.bands())
            ahead = np.concatenate([[0], np.cumsum(fresh)])[sets.bounds]
            records = np.concatenate([np.stack([nodes[fresh], sets.sizes[fresh], low, high], axis=1), keys], axis=1)
            tiles = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((ahead * records.itemsize * _RECORD).astype(np.int32)), pa.py_buffer(records)])
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("text_hash"),
                    pa.ListArray.from_arrays(pa.array(sets.bounds, pa.int32()), pa.array(nodes)),
                    pa.ListArray.from_arrays(pa.array(sets.bounds, pa.int32()), pa.array(sets.sizes)),
                    tiles,
                ],
                names=["id", "text_hash", "nodes", "sizes", "tiles"],
            )

    schema = f"id {kind}, text_hash long, nodes array<long>, sizes array<long>, tiles binary"
    lines = stage(spark, map_text(hashed, schema, describe, ["id", "text", "text_hash"]), "lines-sets")

    groups = stage(spark, families(spark, lines, percent), "lines-groups")
    each = lines.select("id", "text_hash", F.posexplode(F.arrays_zip("nodes", "sizes")).alias("line", "x"))
    each = each.select("id", "text_hash", "line", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("n"))
    one = each.groupBy("node").agg(F.min(F.struct("text_hash", "id", "line", "n")).alias("one"))
    wanted = stage(spark, groups.join(one, "node").select("node", "grp", "one.*"), "lines-wanted")
    sizes = wanted.groupBy("grp").agg(F.count(F.lit(1)).alias("grp_n"), F.sum("n").alias("grp_values"))
    # Written, so that the join has two plain sides and a long group can be split.
    sizes = stage(spark, sizes, "lines-sizes")
    wanted = wanted.join(sizes, "grp").groupBy(F.col("text_hash").alias("one_hash"), F.col("id").alias("one_id"))
    # A document's own lines at most: bounded by the longest text.
    wanted = wanted.agg(F.collect_list(F.struct("line", "grp", "grp_n", "grp_values", "node")).alias("wanted"))

    def lines_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = batch.column("wanted")
        for first, last, raw, offsets in slices(batch, "text", _CHUNK):
            begin, end = line_bounds(raw, offsets)
            bounds = textscan.per_text(begin, offsets)
            out = []
            for k in range(last - first):
                for want in asked[first + k].as_py():
                    at = int(bounds[k]) + want["line"]
                    if at < bounds[k + 1]:
                        out.append((want["grp"], want["grp_n"], want["grp_values"], want["node"], raw[begin[at] : end[at]].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["grp", "grp_n", "grp_values", "node", "values"])

    # Shuffled at every size, so that what is moved follows the input.
    texts = hashed.join(wanted.hint("merge"), (F.col("text_hash") == F.col("one_hash")) & F.col("id").eqNullSafe(F.col("one_id")))
    members = map_text(texts, "grp long, grp_n long, grp_values long, node long, values binary", lines_of, ["wanted", "text"])
    linked = components(spark, verified(members, percent, decode=lambda lines: line_values(lines, width), **_DEALING), "lines-links")

    # Only lines that have a copy or a link go further than their count.
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "line")
    counted = each.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    busy = counted.join(linked, "node", "left").where("copies > 1 or root is not null")
    busy = stage(spark, busy.select("node", F.coalesce("root", "node").alias("root"), "first"), "lines-busy")
    firsts = busy.groupBy("root").agg(F.min("first").alias("first"))
    firsts = stage(spark, busy.select("node", "root").join(firsts, "root").select("node", "first"), "lines-firsts")
    gone = each.join(firsts, "node").where(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.array_sort(F.collect_set("line")).alias("removed"))
    gone = stage(spark, gone, "lines-gone")
    match = (F.col("text_hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id"))
    return lines.join(gone, match, "left").select("id", "text_hash", F.size("nodes").cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """(id, n_lines, n_kept, removed) of each row; ``removed`` lists line numbers, comma-joined."""
    marked = mark(docs, id_col, text_col, percent, width)
    return marked.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("removed")).cast("long").alias("n_kept"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def without(text: str, removed: list[int]) -> str:
    """``text`` without the lines of these numbers (counted among lines with a word)."""
    gone, out, number = set(removed), [], 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            if number not in gone:
                out.append(line)
            number += 1
        else:
            out.append(line)
    return "\n".join(out)


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """``docs`` with the removed lines cut from their texts; documents that lose all their lines are dropped."""
    columns = docs.columns
    own, hashed, gone, empty = private(columns, "own_id", "text_hash", "removed", "emptied")
    marked = mark(docs, id_col, text_col, percent, width).where("size(removed) > 0").dropDuplicates(["id", "text_hash"])
    marked = marked.select(F.col("id").alias(own), F.col("text_hash").alias(hashed), F.col("removed").alias(gone), (F.size("removed") == F.col("n_lines")).alias(empty))
    hit = docs.join(marked.hint("merge"), (F.xxhash64(docs[text_col]) == F.col(hashed)) & docs[id_col].eqNullSafe(F.col(own)), "left")

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        removed = batch.column(gone).to_pylist()
        keep = batch.select(columns)
        if any(removed):
            texts = text_column(batch.column(text_col))
            cut = [without(texts[k].as_py(), lines) if lines else batch.column(text_col)[k].as_py() for k, lines in enumerate(removed)]
            keep = keep.set_column(columns.index(text_col), text_col, pa.array(cut, batch.column(text_col).type))
        yield keep

    rest = hit.where(~F.coalesce(F.col(empty), F.lit(False)))
    return map_text(rest, docs.schema, body, [*columns, gone])
