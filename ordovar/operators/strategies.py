"""The ten strategies. Each takes (part, pos, value) rows and gives the same sorted relation (pos, value); their rounds differ.

Rounds are lazy plans of exchanges by part and sorts inside partitions; a receiver's merge is its partition's sort. Only splitters, a
bounded sample for pivots, and counts per part reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordovar.functions.intmath import ceil_log2
from ordovar.operators.layout import bucket_of, exchanged, global_splitters, local_rank, local_splitters, sorted_by_bucket, width_bucket_of
from ordovar.spec import SortSpec

KEYS = ["value", "pos"]


def _answer(df: DataFrame) -> DataFrame:
    """A single sorted partition's relation."""
    return df.withColumn("pos", F.monotonically_increasing_id()).select("pos", "value")


def splitters_of(df: DataFrame, n: int) -> list:
    return global_splitters(local_splitters(local_rank(df), n), n)


def sequential(df: DataFrame, spec: SortSpec) -> DataFrame:
    return _answer(df.coalesce(1).sortWithinPartitions(*KEYS))


def sequential1(df: DataFrame, spec: SortSpec) -> DataFrame:
    """One partition other than the first sorts."""
    away = exchanged(df.withColumn("__d", F.lit(1)), max(2, spec.n), "__d").sortWithinPartitions(*KEYS)
    return away.withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).select("pos", "value")


def merge_dest(part: Column, n: int, step: int, mapping: int = 0) -> Column:
    """Who holds a part's rows after round step (from 0) of the binary merge tree."""
    if mapping == 0:
        return (part % max(1, n >> (step + 1))).cast("int")
    return (part - part % (2 << step)).cast("int")


def kmerge_dest(part: Column, n: int, step: int, k: int) -> Column:
    active = n
    for _ in range(step + 1):
        active = max(1, -(-active // k)) if active % k else active // k
    return (part % active).cast("int")


def merge_round(df: DataFrame, n: int, dest: Column) -> DataFrame:
    return exchanged(df.withColumn("part", dest), n, "part").sortWithinPartitions(*KEYS)


def mergesort(df: DataFrame, spec: SortSpec) -> DataFrame:
    for step in range(ceil_log2(spec.n)):
        df = merge_round(df, spec.n, merge_dest(F.col("part"), 1 << ceil_log2(spec.n), step, spec.sigma[0]))
    return sequential(df, spec)


def kmerge(df: DataFrame, spec: SortSpec) -> DataFrame:
    active, k, step = spec.n, max(2, spec.sigma[1]), 0
    while active > 1:
        df = merge_round(df, spec.n, kmerge_dest(F.col("part"), spec.n, step, k))
        active, step = -(-active // k), step + 1
    return sequential(df, spec)


def lb_dest(part: Column, value: Column, splitters: list, n: int, i: int) -> Column:
    """Part after round i (from 1) of the load-balanced merge: range bucket inside the group of 2^i parts. Of the group's splitters,
    those from the group's first part on, as many lie below the value as its bucket is beyond that part."""
    g = 1 << i
    base = part - part % g
    return (base + F.greatest(F.lit(0), F.least(F.lit(g - 1), bucket_of(value, splitters) - base))).cast("int")


def lbmergesort(df: DataFrame, spec: SortSpec) -> DataFrame:
    n = spec.n
    splitters = sampled_splitters(df, n, spec.seed)
    rounds = ceil_log2(n)
    for i in range(1, rounds):
        df = merge_round(df, n, lb_dest(F.col("part"), F.col("value"), splitters, n, i))
    return sorted_by_bucket(df.withColumn("part", lb_dest(F.col("part"), F.col("value"), splitters, n, rounds)), max(n, 1 << rounds), "part", KEYS, once=True).select("pos", "value")


def samplesort(df: DataFrame, spec: SortSpec) -> DataFrame:
    splitters = sampled_splitters(df, spec.n, spec.seed)
    return sorted_by_bucket(df.withColumn("part", bucket_of(F.col("value"), splitters)), spec.n, "part", KEYS).select("pos", "value")


def lbkmergesort(df: DataFrame, spec: SortSpec) -> DataFrame:
    """One hop to the bucket, with the received runs kept apart by their sender, and one n-way merge of them."""
    splitters = sampled_splitters(df, spec.n, spec.seed)
    runs = df.withColumnRenamed("part", "run").withColumn("part", bucket_of(F.col("value"), splitters))
    return sorted_by_bucket(runs, spec.n, "part", ["value", "run", "pos"]).select("pos", "value")


def bucketsort(df: DataFrame, spec: SortSpec, span: int | None = None) -> DataFrame:
    if span is None:
        span = int((df.agg(F.max("value")).first()[0] or 0)) + 1
    span += -span % spec.n
    return sorted_by_bucket(df.withColumn("part", width_bucket_of(F.col("value"), span, spec.n)), spec.n, "part", KEYS).select("pos", "value")


def bitonic_rounds(n: int) -> list[tuple[int, int]]:
    """(mask of the partner, bit of the direction) of each compare-split."""
    return [(1 << (i - 1 - j), i) for i in range(1, ceil_log2(n) + 1) for j in range(i)]


def largest_part(df: DataFrame) -> int:
    return df.groupBy("part").count().agg(F.max("count")).first()[0] or 0


def bitonic_round(df: DataFrame, n: int, mask: int, bit: int, slots: int) -> DataFrame:
    """Of partners part and part XOR mask, one keeps the lowest `slots` rows, the other what lies above. A part with fewer rows counts
    as filled up with rows above all others, which need not exist; so parts may be uneven."""
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*KEYS))
    rows = df.withColumn("__p", F.col("part").bitwiseAND(F.lit(~mask))).withColumn("__r", rank)
    rising = F.col("__p").bitwiseAND(F.lit(1 << bit)) == 0
    return rows.withColumn("part", (F.col("__p") + F.when((F.col("__r") <= slots) == rising, 0).otherwise(mask)).cast("int")).drop("__p", "__r")


def bitonicsort(df: DataFrame, spec: SortSpec) -> DataFrame:
    n = 1 << ceil_log2(spec.n)
    slots = largest_part(df)
    for mask, bit in bitonic_rounds(n):
        df = bitonic_round(df, n, mask, bit, slots)
    return sorted_by_bucket(df, n, "part", KEYS, once=True).select("pos", "value")


#: Rows that choose the pivots, and the fixed values of the hash of positions that picks them.
PIVOT_SAMPLE = 4096
PIVOT_FACTOR, PIVOT_RANGE = 2654435761, 1 << 32


def sampled(df: DataFrame, size: int, seed: int = 1) -> list:
    """The sorted values of a random sample of about `size` rows: those whose position hashes below a limit, so that a seed gives one
    result and no order of the input a bad one. One scan, nothing is sorted but the sample."""
    m = df.count()
    chance = (F.pmod("pos", F.lit(1 << 31)) * F.lit(PIVOT_FACTOR) + F.lit(seed)) % F.lit(PIVOT_RANGE)
    limit = min(PIVOT_RANGE, size * PIVOT_RANGE // max(1, m) + 1)
    return sorted(r["value"] for r in df.where((chance < limit) & F.col("value").isNotNull()).select("value").collect())


def sampled_splitters(df: DataFrame, n: int, seed: int = 1) -> list:
    """n - 1 quantiles of a sample. splitters_of() takes the regular sample of the sorted parts, for which every part is sorted first."""
    got = sampled(df, max(PIVOT_SAMPLE, 64 * n), seed)
    return [got[i * len(got) // n] for i in range(1, n)] if got else []


def pivots_of(df: DataFrame, levels: int, seed: int = 1) -> list[list]:
    """For each level its nodes' pivots (null: none): medians of what a sample of about PIVOT_SAMPLE rows has in the node."""
    nodes = [sampled(df, PIVOT_SAMPLE, seed)]
    out = []
    for _ in range(levels):
        cuts = [v[(len(v) - 1) // 2] if v else None for v in nodes]
        out.append(cuts)
        nodes = [part for v, cut in zip(nodes, cuts, strict=True) for part in ([x for x in v if x <= cut], [x for x in v if x > cut])]
    return out


def quicksort_level(df: DataFrame, pivots: list) -> DataFrame:
    """node -> 2 node + (value > the node's pivot)."""
    kind = df.schema["value"].dataType.simpleString()
    above = F.coalesce(F.col("value") > F.get(F.lit(pivots).cast(f"array<{kind}>"), F.col("node")), F.lit(False))
    return df.withColumn("node", (2 * F.col("node") + above.cast("int")).cast("int"))


def quicksort(df: DataFrame, spec: SortSpec) -> DataFrame:
    levels = ceil_log2(spec.n)
    cuts = pivots_of(df, levels, spec.seed)
    df = df.withColumn("node", F.lit(0))
    for level in cuts:
        df = quicksort_level(df, level)
    return sorted_by_bucket(df.drop("part"), 1 << levels, "node", KEYS).select("pos", "value")


ALGORITHMS: dict[str, Callable[[DataFrame, SortSpec], DataFrame]] = {
    "sequential": sequential, "sequential1": sequential1, "mergesort": mergesort, "kmerge": kmerge, "lbmergesort": lbmergesort,
    "lbkmergesort": lbkmergesort, "samplesort": samplesort, "bucketsort": bucketsort, "bitonicsort": bitonicsort, "quicksort": quicksort,
}


def sort(df: DataFrame, spec: SortSpec) -> DataFrame:
    """df: (part, pos, value)."""
    spec.checked(set(ALGORITHMS))
    return ALGORITHMS[spec.algo](df, spec)
