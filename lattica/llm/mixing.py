"""Mixing sources to target weights by systematic sampling.

Documents of a source are put in an order, every document adds the source's
expected copies to a running sum that starts at one random offset, and a
document is emitted once for every integer boundary that its share crosses.
The order follows the size, so the words taken stay within about one large
document of the target.

Running sums need no long sort: rows fall into buckets (source, size class,
hash of the id), buckets are counted with map-side combining, and a row's rank
is the count of all buckets before its own plus its place in it.  Size classes
keep the top four bits of the size, and a class has ``sqrt(rows)/16`` hash
buckets, so neither a hot source nor a group of copies lands in one task.

Sources are counted by partial aggregates; their targets are found in windows
over one row a source, so tens of millions of sources are one task's sort of
names and numbers.

Defined cases: a null or empty text has size 0; null sources form one source, ordered
last; rows that agree in id and size are interchangeable; an empty table gives
an empty result; a source without words has target 0 and takes nothing; a text
of any length is counted whole and moved only by :func:`emit`, as it stands;
other columns may have any names, and :func:`mix` leaves out a kept column that
has the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import private, stage

#: Java's regular expression for a word.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources by capped proportional sharing.

    ``sizes`` has one row a source (no_source, source, source_size), so the
    ordered windows run over as many rows as there are sources, each a name
    and a number.  Sources are filled to a common level of words per weight;
    in order of cap per weight, the level is found where the words left,
    shared by the weights left, first stay within the next source's cap.
    """
    order = Window.orderBy("no_source", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1).cast("int") % len(weights) + 1)
    sized = sizes.withColumn("w", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "no_source", "source")
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = sized.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "no_source", "source", "level"))).over(whole)["level"]
    target = F.when(open_level.isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * open_level))
    return levelled.select("no_source", "source", "source_size", target.alias("target"))


def _hex(column: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


#: Copies of one row that a task makes at once.
_CHUNK = 1000
RESULTS = ("size", "source_size", "target", "copies", "taken")


def mix(
    docs: DataFrame,
    keep: list[str],
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """Rows of ``docs`` (the ``keep`` columns) with size, source_size, target, copies and taken.

    The sized rows are written to the shared folder first, so texts are read
    once; ``keep`` should hold no long column.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.col(id_col).alias("place"),
        size.alias("size"),
    )
    mixed = _placed(spark, stage(spark, rows, "mixing-rows"), weights, share, cap, seed)
    return mixed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in RESULTS], *RESULTS)


def _placed(spark: SparkSession, rows: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    """Sized rows, written before, with source_size, target, copies and taken."""
    sizes = rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = stage(spark, sizes, "mixing-sources")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int((n**0.5) / 16) + 1
    spare = F.greatest(F.length(F.bin("size")) - 4, F.lit(0))
    bucketed = rows.withColumn("class", (F.floor(F.col("size") / F.pow(F.lit(2.0), spare)) * F.pow(F.lit(2.0), spare)).cast("long")).withColumn("part", (_hex(F.concat(F.lit(f"{seed}:"), "name"), 8) % parts).cast("int"))

    key = ["no_source", "source", "class", "part"]
    counts = bucketed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    in_class = Window.partitionBy("no_source", "source", "class")
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(in_class.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    classes = counts.groupBy("no_source", "source", "class").agg(F.sum("n").alias("class_n"))
    before = Window.partitionBy("no_source", "source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("class_ahead", F.coalesce(F.sum("class_n").over(before), F.lit(0)))
    plan = targets(sizes.drop("n"), weights, share, cap)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("offset", _hex(F.concat(F.lit(f"{seed}:"), F.when(F.col("no_source"), "null").otherwise(F.concat(F.lit("="), "source"))), 5) / F.lit(float(1 << 20)))
    buckets = counts.join(classes.join(plan, ["no_source", "source"]), ["no_source", "source", "class"])
    buckets = stage(spark, buckets.select(*key, (F.col("ahead") + F.col("class_ahead")).alias("start"), "source_size", "target", "rate", "offset"), "mixing-buckets")

    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", F.col("place").asc_nulls_first())) - 1
    ranked = bucketed.withColumn("rank", rank).join(buckets, key)
    at = F.col("start") + F.col("rank")
    copies = (F.floor((at + 1) * F.col("rate") + F.col("offset")) - F.floor(at * F.col("rate") + F.col("offset"))).cast("long")
    ranked = ranked.withColumn("copies", F.least(copies, F.lit(int(-(-cap // 1)))))
    return ranked.withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """The mixture itself: every column of ``docs``, one row for each copy.

    Words are counted once; copies are worked out from written rows of numbers
    and meet the rows of ``docs`` by two hashes of all columns (but maps).
    Rows alike in all of them share their copies: one stands for all, and its
    copies are dealt in chunks.
    """
    spark = docs.sparkSession
    columns = docs.columns
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    one, two, copies, same = private(columns, "hash_1", "hash_2", "copies", "same")
    keyed = docs.withColumns({one: F.xxhash64(F.lit(1), *hashed), two: F.xxhash64(F.lit(2), *hashed)})
    rows = keyed.select(
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.col(id_col).alias("place"),
        size.alias("size"),
        F.col(one).alias("one"),
        F.col(two).alias("two"),
    )
    placed = _placed(spark, stage(spark, rows, "mixing-rows"), weights, share, cap, seed)
    taken = placed.groupBy(F.col("one").alias(one), F.col("two").alias(two)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(same))
    taken = stage(spark, taken.where(F.col(copies) > 0), "mixing-taken")
    once = keyed.join(taken.where(F.col(same) == 1).hint("shuffle_hash"), [one, two])
    out = once.withColumn(same, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns)
    alike = taken.where(F.col(same) > 1)
    if alike.isEmpty():
        return out
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row")
    whole = keyed.join(alike, [one, two]).groupBy(one, two, copies).agg(row)
    chunks = whole.select("row", F.col(copies).alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / _CHUNK))).alias("chunk"))
    chunks = chunks.repartition("n", "chunk")
    dealt = chunks.select("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(_CHUNK), F.col("n") - F.col("chunk") * _CHUNK))).alias("k"))
    return out.unionByName(dealt.select("row.*"))


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text,''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[^w]', '', 'g')) AS size FROM {documents}
), src AS (
  SELECT source IS NULL AS no_source, coalesce(source,'') AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1, 2
), weighed AS (
  SELECT *, [3,1,2][((row_number() OVER (ORDER BY no_source, source COLLATE "C")) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () AS total FROM src
), levels AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(w) OVER (ORDER BY most / w, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), opened AS (
  SELECT arg_min(level, struct_pack(r := most / w, n := no_source, s := source)) AS open_level FROM levels WHERE level <= most / w
), plan AS (
  SELECT no_source, source, source_size, CASE WHEN open_level IS NULL THEN most ELSE least(most, w * open_level) END AS target,
    ('0x' || substr(md5('0:' || CASE WHEN no_source THEN 'null' ELSE '=' || source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift
  FROM levels, opened
), placed AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source,'') AS source, size,
    (size // (1 << greatest(length(bin(size)) - 4, 0))) * (1 << greatest(length(bin(size)) - 4, 0)) AS class,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (floor(sqrt((SELECT count(*) FROM sized)) / 16)::BIGINT + 1) AS part FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY class, part, size, doc_id NULLS FIRST) - 1 AS place FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN source_size > 0 THEN least(2,
  floor((place + 1) * (target / source_size) + shift) - floor(place * (target / source_size) + shift))::BIGINT ELSE 0 END * size AS taken,
  CASE WHEN source_size > 0 THEN least(2,
  floor((place + 1) * (target / source_size) + shift) - floor(place * (target / source_size) + shift))::BIGINT ELSE 0 END AS copies
FROM ranked JOIN plan USING (no_source, source)
"""
