"""Where rows are: shares, buckets, splitters, exchange and global positions.

Nothing is gathered: a global order is a column `pos`, from counts per bucket and the place inside the sorted physical partition.
Buckets follow the rule (s[i-1], s[i]]: a key that equals a splitter goes left. Null keys come first, NaN last.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL = (1 << 33) - 1


#: Splitters up to which the comparisons are code; more are a sorted array that is searched by halving.
INLINE_SPLITTERS = 127


def bucket_of(key: Column, splitters: list) -> Column:
    """Number of splitters below the key; by halving, so log2(n) comparisons a row."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > F.lit(splitters[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    if len(splitters) <= INLINE_SPLITTERS:
        found = tree(0, len(splitters))
    else:
        held = F.lit(splitters)
        halves, step = [], 1 << (len(splitters).bit_length() - 1)
        while step:
            halves.append(step)
            step >>= 1
        found = F.aggregate(F.lit(halves), F.lit(0), lambda at, h: F.when((at + h <= len(splitters)) & (F.get(held, at + h - 1) < key), at + h).otherwise(at).cast("int"))
    return F.when(key.isNull(), F.lit(0)).otherwise(found).cast("int")


def width_bucket_of(key: Column, span: int, n: int) -> Column:
    """Fixed-width buckets of [0, span), clamped at both ends."""
    width = max(1, span // n)
    return F.when(key.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.expr("0") + F.floor(key / F.lit(width)), F.lit(n - 1)))).cast("int")


def exchanged(df: DataFrame, n: int, dest: str) -> DataFrame:
    """Every row on the partition that dest names."""
    return df.repartitionById(n, F.col(dest))


def quantiles(df: DataFrame, key: str, n: int) -> list:
    """n - 1 splitters from a bounded sketch; any splitters give right positions, good ones give even partitions."""
    if n < 2:
        return []
    got = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [i / n for i in range(1, n)], 1000).alias("q")).first()["q"]
    return sorted(set(got or []))


def sorted_by_bucket(df: DataFrame, n: int, bucket: str, keys: list[str], once: bool = False) -> DataFrame:
    """df with `pos`: exchange by bucket, local sort, offset of the bucket plus the place in the partition.

    The rows of each bucket are counted first. Where df is a scan with a bucket expression, that reads one column and shuffles nothing;
    where df is costly to make (`once`), the sorted partitions are cached, in memory or on disk, and counted there.
    """
    local = exchanged(df, n, bucket).sortWithinPartitions(*keys)
    if once:
        local = local.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r[bucket]: r["count"] for r in (local if once else df).groupBy(bucket).count().collect()}  # n rows
    offsets, at = [], 0
    for i in range(n):
        offsets.append(at)
        at += counts.get(i, 0)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))
    return local.withColumn("pos", F.get(F.lit(offsets).cast("array<long>"), F.col(bucket)) + place)


def positioned(df: DataFrame, key: str, n: int = 8, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `pos`, its place in the order of key."""
    rows = df.withColumn("__b", bucket_of(F.col(key), quantiles(df, key, n)))
    return sorted_by_bucket(rows, n, "__b", [key, *ties]).drop("__b")


def share_of(pos: Column, m: int, n: int) -> Column:
    """The part of a position when m rows are dealt out evenly, the first m % n parts getting one more."""
    q, r = divmod(m, n)
    cut = r * (q + 1)
    return F.when(pos < cut, F.floor(pos / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((pos - cut) / F.lit(max(1, q)))).cast("int")


def scattered(df: DataFrame, key: str, m: int, n: int, order: int = 8) -> DataFrame:
    """df with pos (order of the unique key) and part (even shares)."""
    return positioned(df, key, order).withColumn("part", share_of(F.col("pos"), m, n))


def scattered_by(df: DataFrame, counts: list[int], displs: list[int]) -> DataFrame:
    """Slices [displ, displ + count) of pos, one a part; slices may overlap or leave rows out."""
    slices = df.sparkSession.createDataFrame([(i, c, d) for i, (c, d) in enumerate(zip(counts, displs, strict=True))], "part int, cnt long, displ long")
    return df.join(F.broadcast(slices), (F.col("pos") >= F.col("displ")) & (F.col("pos") < F.col("displ") + F.col("cnt"))).withColumn("local_pos", F.col("pos") - F.col("displ")).drop("cnt", "displ")


def local_rank(df: DataFrame, part: str = "part", keys: tuple[str, ...] = ("value", "pos"), name: str = "i") -> DataFrame:
    """Place of each row in its part's order, from 0. A part is a node's share: choose n so that one fits an executor."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1).cast("long"))


def local_splitters(ranked: DataFrame, n: int) -> DataFrame:
    """(part, k, splitter): the regular sample of each sorted part, every (size div n)-th row, n - 1 of them."""
    sized = ranked.join(ranked.groupBy("part").agg(F.count("*").alias("c")), "part").withColumn("j", F.greatest(F.lit(1), F.floor(F.col("c") / n)))
    return sized.where((F.col("i") > 0) & (F.col("i") % F.col("j") == 0) & (F.col("i") / F.col("j") <= n - 1)).select("part", F.floor(F.col("i") / F.col("j")).alias("k"), F.col("value").alias("splitter"))


#: Local splitters that the driver may sort by itself.
DRIVER_SAMPLE = 1 << 18


def global_splitters(sample: DataFrame, n: int, on_driver: int = DRIVER_SAMPLE) -> list:
    """n - 1 splitters: the regular sample of the sorted n (n - 1) local ones. The driver sorts up to `on_driver` of them; more are
    sorted like any table, and only the n - 1 that are picked reach it."""
    if n * (n - 1) <= on_driver:
        got = sorted(r["splitter"] for r in sample.select("splitter").collect())
        step = max(1, len(got) // n)
        return [got[i] for i in range(step, len(got), step)][: n - 1]
    step = max(1, sample.count() // n)
    picked = positioned(sample.select("splitter"), "splitter", 64).where((F.col("pos") > 0) & (F.col("pos") % step == 0) & (F.col("pos") < step * n))
    return [r["splitter"] for r in sorted(picked.collect(), key=lambda r: r["pos"])][: n - 1]


def histogram(df: DataFrame, src: str = "part", dst: str = "bucket") -> DataFrame:
    return df.groupBy(src, dst).agg(F.count("*").alias("cnt"))


def displacements(hist: DataFrame, by: str, over: str, name: str) -> DataFrame:
    """Exclusive prefix sums of cnt: for each `by`, in order of `over`."""
    w = Window.partitionBy(by).orderBy(over).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn(name, F.coalesce(F.sum("cnt").over(w), F.lit(0)))


def described(df: DataFrame) -> str:
    """Where a relation lies and how it is dealt: cached or planned, partitions, columns."""
    level = df.storageLevel
    medium = " and ".join(name for name, used in (("memory", level.useMemory), ("disk", level.useDisk)) if used) or "plan"
    return f"{medium}, {df.rdd.getNumPartitions()} partitions, ({', '.join(f'{c} {t}' for c, t in df.dtypes)})"
