"""Groups of similar sets: exact verification in blocks, and distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import ship, stage


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest node reachable.

    Every root hooks to its smallest neighbour, chains of hooks are shortened
    by pointer jumping, and edges are redrawn between roots.  A root that is
    not the smallest of its component hooks within two rounds, so rounds grow
    with the logarithm of the nodes.  All steps are joins and partial
    aggregates; each round is written, so nothing is collected and lineage
    stays short.
    """
    edges = stage(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        hooks = edges.select(F.col("b").alias("from"), F.col("a").alias("to")).groupBy("from").agg(F.min("to").alias("to"))
        hooks = stage(spark, hooks, f"{name}-hooks")
        while True:
            nxt = hooks.select(F.col("from").alias("to"), F.col("to").alias("further"))
            jumped = stage(spark, hooks.join(nxt, "to", "left").select("from", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"{name}-jumps")
            hooks = jumped.select("from", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = stage(spark, labels.join(hooks.withColumnRenamed("from", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-labels")
        for end in ("a", "b"):
            edges = edges.join(hooks.withColumnRenamed("from", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = stage(spark, edges, f"{name}-edges")
    return labels


def as_hashes(values: list[bytes]) -> list[np.ndarray]:
    """Sorted arrays of 64-bit hashes from their bytes."""
    return [np.frombuffer(own, dtype=np.uint64) for own in values]


def bitmaps(arrays: list[np.ndarray], bits: int) -> np.ndarray:
    """A hashed bitmap of each set, as rows of 64-bit words."""
    table = np.zeros((len(arrays), bits), dtype=bool)
    for k, values in enumerate(arrays):
        table[k, (values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(table, axis=1).view(np.uint64)


def links(arrays: list[np.ndarray], sides: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is ``percent`` or more.

    Bitmaps bound the overlap first; what is left is intersected exactly.
    """
    if len(arrays) == 2:
        a, b = arrays
        if (cross and sides[0] == sides[1]) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
            return []
        common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return [(0, 1)] if 100 * common >= percent * (len(a) + len(b) - common) else []
    sizes = np.array([len(a) for a in arrays])
    maps = bitmaps(arrays, 1 << int(min(16, max(6, (2 * int(sizes.max()) - 1).bit_length()))))

    def holds(a: int, b: int, need: int) -> bool:
        at = np.minimum(np.searchsorted(arrays[b], arrays[a]), len(arrays[b]) - 1)
        return int((arrays[b][at] == arrays[a]).sum()) >= need

    return forest(maps, sizes, sides, cross, percent, holds)


def forest(maps: np.ndarray, sizes: np.ndarray, sides: np.ndarray, cross: bool, percent: int, holds: Callable[[int, int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the bitmaps allow and ``holds``, if given, confirms.

    Rows already connected inside the block are not compared again, so a family
    of near copies costs one pass from its first row.  Sets are taken by size,
    so partners of fitting size are neighbours; a set bit that the other bitmap
    lacks proves a value that the other set lacks, so bit counts bound the
    overlap from above.
    """
    order = np.argsort(sizes, kind="stable")
    maps, sizes, sides = maps[order], sizes[order], sides[order]
    tree, out, apart = np.arange(len(order)), [], len(order) - 1
    ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for a in range(len(order)):
        if not apart:
            # All rows are connected, so no pair can add a link.
            break
        b = np.arange(a + 1, ends[a])
        b = b[tree[b] != tree[a]]
        if cross:
            b = b[sides[b] != sides[a]]
        if not len(b):
            continue
        need = -(-percent * (sizes[a] + sizes[b]) // (100 + percent))
        most = np.minimum(
            sizes[a] - np.bitwise_count(maps[a] & ~maps[b]).sum(axis=1, dtype=np.int64),
            sizes[b] - np.bitwise_count(maps[b] & ~maps[a]).sum(axis=1, dtype=np.int64),
        )
        fit = most >= need
        for k, least in zip(b[fit].tolist(), need[fit].tolist(), strict=True):
            if tree[a] != tree[k] and (holds is None or holds(int(order[a]), int(order[k]), least)):
                tree[tree == tree[k]] = tree[a]
                out.append((int(order[a]), int(order[k])))
                apart -= 1
    return out


def in_blocks(rows: DataFrame, size: Column, weight: Column, settle: Callable[[bool, list[tuple]], list[tuple[int, int]]], decode: Callable[[list], list] | None = None, block: int = 128, spread: int = 16, block_rows: int = 2048, block_bytes: int = 8 << 20) -> DataFrame:
    """(grp, a, b): the links (a, b) that ``settle(cross, rows)`` finds within each group, dealt into pairs of blocks.

    ``rows`` has grp, node and what ``settle`` needs besides, of which ``decode``
    takes the last column of many rows at once; ``size`` is the
    rows and ``weight`` the bytes of the row's group.  A group of up to
    ``block`` rows is one block; a larger one is dealt by the hash of the node
    into up to ``spread``, and into more as soon as a block would pass
    ``block_rows`` rows or ``block_bytes``.  Every pair of blocks is one task's
    work, and the pairs of a group go to partitions in turn, so no group lands
    in one task and what a task holds has a bound.
    """
    spark = rows.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.greatest(F.least(F.ceil(size / block), F.lit(spread)), F.ceil(size / block_rows), F.ceil(weight / block_bytes), F.lit(1)).cast("int")
    more = [c for c in rows.columns if c not in ("grp", "grp_n", "grp_values", "node")]
    dealt = rows.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("grp", "nb", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *more)
    turn = F.col("i").cast("long") * (2 * F.col("nb") - F.col("i") + 1) / 2 + F.col("j") - F.col("i")
    dealt = dealt.withColumn("to", F.pmod(F.xxhash64("grp") + turn.cast("long"), F.lit(parts)).cast("int")).drop("nb")
    dealt = dealt.repartitionById(parts, "to").drop("to").sortWithinPartitions("grp", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def ended() -> list[tuple[int, int, int]]:
            return [(key[0], a, b) for a, b in settle(key[1] != key[2], held)] if len(held) > 1 else []

        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for first in range(0, batch.num_rows, 1000):
                columns = [batch.column(k).slice(first, 1000).to_pylist() for k in range(batch.num_columns)]
                if decode is not None:
                    columns[-1] = decode(columns[-1])
                for grp, i, j, *row in zip(*columns, strict=True):
                    if (grp, i, j) != key:
                        found += ended()
                        key, held = (grp, i, j), []
                    held.append(tuple(row))
            if found:
                yield as_batch(found)
        found = ended()
        if found:
            yield as_batch(found)

    def as_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["grp", "a", "b"])

    return dealt.mapInArrow(work, "grp long, a long, b long")


def verified(members: DataFrame, percent: int, decode: Callable[[list[bytes]], list[np.ndarray]] = as_hashes, **dealing: int) -> DataFrame:
    """Links (a, b) between the members of each group; ``dealing`` are the sizes of :func:`in_blocks`.

    ``members`` has grp, grp_n (members), grp_values (values in all their
    sets), node and values (bytes that ``decode`` makes sorted arrays of).
    """

    def settle(cross: bool, rows: list[tuple]) -> list[tuple[int, int]]:
        found = links([values for _, _, values in rows], np.array([own for own, _, _ in rows]), cross, percent)
        return [(rows[a][1], rows[b][1]) for a, b in found]

    return in_blocks(members, F.col("grp_n"), F.col("grp_values") * 8, settle, decode, **dealing).select("a", "b")


#: One node in ``SHARE`` is looked at to find long tiles; a tile with ``SEEN`` of them is long, and at most ``MOST_LONG`` tiles are.
SHARE, SEEN, MOST_LONG = 64, 64, 100_000


def long_tiles(spark: SparkSession, tiles: DataFrame, name: str, whole: bool = True) -> DataFrame | None:
    """(key) of the tiles with many rows, or None where there are none.

    Rows are counted with partial aggregates over the nodes whose hash falls in
    one of ``SHARE`` parts; ``tiles`` that are not ``whole`` hold no others.  The bound on a long tile rises with the table until
    there are at most ``MOST_LONG`` of them, so the table can be broadcast and
    what isn't in it is no longer than the rows over ``MOST_LONG``.  Being long
    only says how a tile is dealt, not what is found in it.
    """
    some = tiles.where(F.pmod(F.xxhash64("node"), F.lit(SHARE)) == 0) if whole else tiles
    counts = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(spark, counts.where(F.col("n") >= SEEN), f"{name}-long")
    least = SEEN
    while (found := counts.where(F.col("n") >= least).count()) > MOST_LONG:
        least *= 2
    return counts.where(F.col("n") >= least).select("key") if found else None


def divided(tiles: DataFrame, keys: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary tiles, and the different rows (key, node, ...) of long ones with their tile's ``size``."""
    if keys is None:
        return tiles, None
    own = tiles.join(F.broadcast(keys), "key")
    more = [F.first(c).alias(c) for c in tiles.columns if c not in ("key", "node")]
    own = own.groupBy("key", "node").agg(*more) if more else own.distinct()
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    return tiles.join(F.broadcast(keys), "key", "left_anti"), own.join(F.broadcast(sizes), "key")


def grouped(spark: SparkSession, tiles: DataFrame, name: str, sketches: DataFrame, percent: int, whole: int = 4) -> DataFrame:
    """(node, grp) of the nodes that share a tile with another, from tiles (key, node).

    Only pairs that the sketches (node, n, bits) allow tie nodes together, so
    chance meetings do not; groups are the components of the rest.  Tiles of at
    most ``whole`` nodes give their pairs, each looked at once whatever tiles it
    shares; longer ones are gone through in blocks, and the longest are dealt
    to them without ever lying in one task.
    """
    cold, hot = divided(tiles, long_tiles(spark, tiles, name))
    order = Window.partitionBy("key").orderBy("node")
    seen = cold.select("key", "node", *[F.lag("node", k).over(order).alias(f"before{k}") for k in range(1, whole)])
    seen = seen.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    seen = stage(spark, seen, f"{name}-tiles")
    small = seen.where(F.col("size") <= whole).select(F.col("node").alias("b"), F.explode(F.array(*[f"before{k}" for k in range(1, whole)])).alias("a"))
    ends = [sketches.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("bits").alias(f"bits_{e}")) for e in ("a", "b")]
    few = possible(small.where("a <> b").distinct().join(ends[0], "a").join(ends[1], "b"), percent)
    large = seen.where(F.col("size") > whole).select("key", "node", "size").distinct()
    if hot is not None:
        large = large.unionByName(hot.where("size > 1"))
    large = large.select(F.col("key").alias("grp"), F.col("size").alias("grp_n"), "node").join(sketches, "node")

    def settle(cross: bool, rows: list[tuple]) -> list[tuple[int, int]]:
        width = min(len(bits) for *_, bits in rows)
        maps = np.stack([folded(np.frombuffer(bits, dtype=np.uint64), width // 8) for *_, bits in rows])
        found = forest(maps, np.array([n for _, _, n, _ in rows]), np.array([side for side, *_ in rows]), cross, percent)
        return [(rows[a][1], rows[b][1]) for a, b in found]

    # A sketch has at most 8 KB, so a block's rows bound its bytes.
    many = in_blocks(large, F.col("grp_n"), F.lit(0), settle).select("a", "b")
    return components(spark, few.unionByName(many), name).withColumnRenamed("root", "grp")


def labelled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of ``n`` over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller width: a bit is set where one of its sources is."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def sketch(values: np.ndarray) -> bytes:
    """A hashed bitmap of a set: two to four bits for each value, and 8 KB at most."""
    bits = 1 << min(16, max(6, (2 * len(values) - 1).bit_length()))
    return bitmaps([values], bits)[0].tobytes()


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow the similarity; a longer bitmap is folded to the shorter."""
    ship(pairs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                u, v = folded(u, len(v)), folded(v, len(u))
                most = min(n_a - int(np.bitwise_count(u & ~v).sum()), n_b - int(np.bitwise_count(v & ~u).sum()))
                keep.append(most >= -(-percent * (n_a + n_b) // (100 + percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(work, "a long, b long")
