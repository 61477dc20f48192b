"""Merging of sorted runs and compare-split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kway_merge(runs: DataFrame, group: str = "group") -> DataFrame:
    """(group, i, value): all runs of a group in one order, ties to the smaller run. Empty runs add nothing."""
    return runs.select(group, (F.row_number().over(Window.partitionBy(group).orderBy("value", "run")) - 1).cast("long").alias("i"), "value")


def compare_split(pairs: DataFrame, keep: str) -> DataFrame:
    """Of two runs a and b of each pair, the size(a) smallest (keep = low) or largest (high) values, in order. pairs: (pair, a, b)."""
    merged = F.array_sort(F.concat("a", "b"))
    kept = F.slice(merged, 1, F.size("a")) if keep == "low" else F.slice(merged, F.size("b") + 1, F.size("a"))
    return pairs.select("pair", F.posexplode(kept).alias("i", "value")).withColumn("i", F.col("i").cast("long"))
