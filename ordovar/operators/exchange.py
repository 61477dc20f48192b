"""The collective data movements, as changes of (part, local_pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alltoall(df: DataFrame, count: int) -> DataFrame:
    """Block transpose: block d of part s becomes block s of part d."""
    return df.select(F.floor(F.col("local_pos") / count).cast("int").alias("part"), (F.col("part") * count + F.col("local_pos") % count).cast("long").alias("local_pos"), "value")


def alltoallv(df: DataFrame, displs: DataFrame) -> DataFrame:
    """Personalised exchange: rows (part, bucket, k: place among the rows for that bucket) to part = bucket at rdispl + k.
    displs: (part, bucket, rdispl), as many rows as pairs of parts."""
    return df.join(F.broadcast(displs.select("part", "bucket", "rdispl")), ["part", "bucket"]).select(F.col("bucket").alias("part"), (F.col("rdispl") + F.col("k")).alias("local_pos"), "value")


def sendrecv(df: DataFrame, mask: int) -> DataFrame:
    """Every part swaps its rows with part XOR mask."""
    return df.withColumn("part", F.col("part").bitwiseXOR(F.lit(mask)).cast("int"))


def gatherv(df: DataFrame) -> DataFrame:
    """(pos, value): parts one after the other, without moving them. df: (part, local_pos, value)."""
    counts = sorted((r["part"], r["count"]) for r in df.groupBy("part").count().collect())  # n rows
    rows, at = [], 0
    for p, c in counts:
        rows.append((p, at))
        at += c
    offsets = df.sparkSession.createDataFrame(rows, "part int, displ long")
    return df.join(F.broadcast(offsets), "part").select((F.col("displ") + F.col("local_pos")).alias("pos"), "value")


def sendrecv_slices(df: DataFrame, slices: DataFrame) -> DataFrame:
    """Every part sends a slice of its rows to a partner and keeps its first rows: of (part, local_pos, value), part p's rows from sdispl
    on, scount of them, come to stand at the partner from rdispl on; what p has from `keep` on is overwritten or trimmed.
    slices: (part, partner, sdispl, scount, rdispl, keep), one row a part."""
    rows = df.join(F.broadcast(slices), "part")
    kept = rows.where(F.col("local_pos") < F.col("keep")).select("part", "local_pos", "value")
    sent = rows.where((F.col("local_pos") >= F.col("sdispl")) & (F.col("local_pos") < F.col("sdispl") + F.col("scount")))
    return kept.unionByName(sent.select(F.col("partner").alias("part"), (F.col("rdispl") + F.col("local_pos") - F.col("sdispl")).alias("local_pos"), "value"))


def gather(df: DataFrame, count: int) -> DataFrame:
    """(pos, value): equal shares of count rows, one part after the other."""
    return df.select((F.col("part") * F.lit(count).cast("long") + F.col("local_pos")).alias("pos"), "value")


def bcast(df: DataFrame, n: int) -> DataFrame:
    """Every row on every one of n parts."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def appended(df: DataFrame, received: DataFrame) -> DataFrame:
    """What each part receives, behind what it has: (part, local_pos, value)."""
    sizes = df.groupBy("part").agg(F.count("*").alias("c"))  # a row a part
    moved = received.join(F.broadcast(sizes), "part", "left").select("part", (F.col("local_pos") + F.coalesce("c", F.lit(0))).alias("local_pos"), "value")
    return df.select("part", "local_pos", "value").unionByName(moved)
