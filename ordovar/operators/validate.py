"""Checks of a result: its order across partitions, and that it is a permutation of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inversions(df: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(pos, before, value) where a value is below the one at pos - 1. By blocks of positions that overlap by one row, so that no
    window holds more than a block and no boundary is missed."""
    own = df.select("pos", "value", F.floor(F.col("pos") / block).alias("b"), F.lit(True).alias("own"))
    edge = df.where(F.col("pos") % block == block - 1).select("pos", "value", (F.floor(F.col("pos") / block) + 1).alias("b"), F.lit(False).alias("own"))
    lagged = own.unionAll(edge).withColumn("before", F.lag("value").over(Window.partitionBy("b").orderBy("pos")))
    return lagged.where(F.col("own") & (F.col("before") > F.col("value"))).select("pos", "before", "value")


def checksum(df: DataFrame) -> DataFrame:
    """count, sum and xor: equal for permutations."""
    return df.agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"), F.bit_xor("value").alias("mixed"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.select("value").exceptAll(b.select("value")).isEmpty() and b.select("value").exceptAll(a.select("value")).isEmpty()
