"""Connected components of an edge table, distributed, by alternating large-star and small-star steps.

Every round is written to the shared folder and the one before is dropped, so that a lost executor costs one round, the plan stays
short and the disk holds two rounds. Nothing but a count and a hash sum of each round reaches the driver. A hot centre's neighbours are
aggregated before they are shuffled, and the edges of hot centres, a bounded number, are dealt to several tasks. In a small-star step
a node has as many edges as it has neighbours below it, at most one a round from each large-star centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ordovar.llm.common import drop_path, joined_hot, scratch, stored


def _largest(edges: DataFrame, total: int, spent: list[str]) -> DataFrame:
    """edges: u > v, here and in the result; total: how many."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least, path = stored(edges.sparkSession, edges.select("u", "v").union(back).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), "least")
    spent.append(path)
    return joined_hot(back, least, "u", 2 * total, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smallest(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another node; component: the smallest node that is reachable.

    Null ends, loops and repeated edges are no links. No edges: no rows.
    """
    spark = edges.sparkSession

    def settled(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        seen, path = Observation(), scratch(spark, "edges")
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
        got = seen.get
        return spark.read.schema("u long, v long").parquet(path), path, (got["n"], got["h"])

    ends = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    now, path, mark = settled(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    for _ in range(max_rounds):
        if not mark[0]:
            break
        spent, before = [path], mark
        now, path, mark = settled(_smallest(_largest(now, mark[0], spent)))
        for old in spent:
            drop_path(spark, old)
        if mark == before:
            break
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
