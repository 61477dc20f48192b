"""Who talks to whom, step by step, and how busy the parts are on average."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordovar.functions.intmath import ceil_log2

ROW = "step int, part int, role string, peer int"


def rows(n: int, algo: str, mapping: int = 0, k: int = 2) -> list[tuple[int, int, str, int]]:
    out = []

    def talk(step: int, sender: int, receiver: int) -> None:
        out.append((step, sender, "send", receiver))
        out.append((step, receiver, "receive", sender))

    levels = ceil_log2(n)
    if algo == "mergesort":
        for s in range(levels):
            half = n >> (s + 1)
            for r in range(half):
                talk(s, *((r + half, r) if mapping == 0 else ((2 * r + 1) << s, (2 * r) << s)))
    elif algo == "kmerge":
        active, s = n, 0
        while active > 1:
            left = active // k if active >= k else 1
            for p in range(left, active):
                talk(s, p, p % left)
            active, s = left, s + 1
    elif algo == "quicksort":
        for s in range(levels):
            gap = n >> (s + 1) if mapping == 0 else 1 << s
            owners = range(0, n, 2 * gap) if mapping == 0 else range(gap)
            for o in owners:
                talk(s, o, o + gap)
    elif algo == "bitonicsort":
        s = 0
        for i in range(1, levels + 1):
            for j in range(i):
                for p in range(n):
                    out.append((s, p, "exchange", p ^ 1 << (i - 1 - j)))
                s += 1
    elif algo in ("lbmergesort", "lbkmergesort"):
        # the lower half of a group meets the upper one part by part, turned by one more place each time, so that all pairs meet and none waits
        s = 0
        for g in (1 << i for i in range(levels)):
            for turn in range(g):
                for p in range(n):
                    low, paired = not p & g, (p - p % g) ^ g
                    out.append((s, p, "exchange", paired + (p + turn if low else p - turn) % g))
                s += 1
    else:
        raise ValueError(f"{algo!r} has no stencil")
    return sorted(out)


def stencil(spark: SparkSession, n: int, algo: str, mapping: int = 0, k: int = 2) -> DataFrame:
    return spark.createDataFrame(rows(n, algo, mapping, k), ROW)


def token_owner(i: int, n: int, mapping: int = 0) -> int:
    """The part that holds the i-th range after the pivot tree: i itself, or its bits reversed."""
    return i if mapping == 0 else int(f"{i:0{max(1, ceil_log2(n))}b}"[::-1], 2)


def token_owners(spark: SparkSession, n: int) -> DataFrame:
    """(mapping, i, owner): who holds the i-th range after the pivot tree."""
    return spark.createDataFrame([(m, i, token_owner(i, n, m)) for m in (0, 1) for i in range(n)], "mapping int, i int, owner int")


def efficiency(spark: SparkSession, sizes: list[int], fan_ins: list[int]) -> DataFrame:
    """(algo, n, k, phi): mean share of busy parts. Of a k-ary tree with m = floor(log_k n + 1) levels, level i keeps n / k^i busy."""
    grid = spark.createDataFrame([(n, k) for n in sizes for k in fan_ins], "n int, k int")
    m = F.floor(F.round(F.log(F.col("n")) / F.log(F.col("k")), 9) + 1).cast("int")
    busy = F.aggregate(F.sequence(F.lit(0), F.col("m") - 1), F.lit(0.0), lambda a, i: a + F.col("n") / F.pow(F.col("k"), i))
    tree = grid.withColumn("m", m).select(F.when(F.col("k") == 2, "mergesort").otherwise("kmerge").alias("algo"), "n", "k", (busy / (F.col("n") * F.col("m"))).alias("phi"))
    full = spark.createDataFrame([(a, n, 0, 1.0) for a in ("bitonicsort", "bucketsort", "lbkmergesort", "lbmergesort", "samplesort") for n in sizes], "algo string, n int, k int, phi double")
    # the pivot tree keeps 2^i parts busy on level i, as the merge tree does from its other end
    pivots = tree.where("k = 2").withColumn("algo", F.lit("quicksort"))
    return tree.unionByName(pivots).unionByName(full)
