"""Benchmark logs to tables: parsing, averages, pivots, skew, grids, cost fits; and the timing of phases."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = r"result_n(\d+)_M(\d+)_(\w+)_s(\d+)_t(\d+)"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line); line_no orders the lines of a file."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def parse_logs(lines: DataFrame) -> DataFrame:
    """(file, phase, node, us): the phase of a line is the last heading above it in its file."""
    heading = F.regexp_extract("line", r'^\s*Phase "([^"]*)":', 1)
    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("phase", F.last(F.when(heading != "", heading), ignorenulls=True).over(above))
    node, us = (F.regexp_extract("line", r"^\s*node\s+(\d+):\s*(\d+) microsecs", i) for i in (1, 2))
    return marked.where(node != "").select("file", "phase", node.cast("int").alias("node"), us.cast("long").alias("us"))


def with_dimensions(parsed: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("file", NAME, i)
    return parsed.select(part(3).alias("algo"), part(1).cast("int").alias("n"), part(2).cast("long").alias("m"), part(4).cast("int").alias("seed"), part(5).cast("int").alias("trial"), "phase", "node", "us")


def baseline_everywhere(runs: DataFrame) -> DataFrame:
    """Rows of the sequential strategy repeated for every n that occurs."""
    ns = runs.select("n").distinct().withColumnRenamed("n", "n2")
    return runs.where("algo <> 'sequential'").unionByName(runs.where("algo = 'sequential'").drop("n").join(F.broadcast(ns)).withColumnRenamed("n2", "n"))


def averages(runs: DataFrame) -> DataFrame:
    """(algo, m, n, us): whole-number mean over seeds and trials of the root's total."""
    return phase_of(runs, "spd", 0).groupBy("algo", "m", "n").agg(F.expr("sum(us) div count(*)").alias("us"))


def pivoted(avg: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    return avg.groupBy(rows).pivot(columns, values).agg(F.max("us"))


def skew(runs: DataFrame) -> DataFrame:
    """(algo, n, phase, node, us, skew): mean time of each node, and the largest over the mean of the nodes."""
    per = runs.groupBy("algo", "n", "phase", "node").agg(F.avg("us").alias("us"))
    w = Window.partitionBy("algo", "n", "phase")
    return per.withColumn("skew", F.max("us").over(w) / F.avg("us").over(w))


def campaign(spark: SparkSession, trials: int, exponents: list[int], ns: list[int], seeds: int, algos: list[str]) -> DataFrame:
    """The grid of runs; one part runs only the sequential strategy, which runs on one part only. Its size is that of its lists."""
    dim = lambda values: F.explode(F.array(*(F.lit(v) for v in values)))
    grid = spark.range(1).select(dim(range(1, trials + 1)).alias("trial"))
    for name, values in (("m", [1 << e for e in exponents]), ("n", ns), ("seed", range(1, seeds + 1)), ("algo", algos)):
        grid = grid.select("*", dim(values).alias(name))
    grid = grid.withColumn("m", F.col("m").cast("long"))
    return grid.where((F.col("n") == 1) == (F.col("algo") == "sequential"))


def humanised(size: Column) -> Column:
    return F.when(size >= 1 << 30, F.concat(F.floor(size / (1 << 30)), F.lit(" GB"))).when(size >= 1 << 20, F.concat(F.floor(size / (1 << 20)), F.lit(" MB"))).when(size >= 1 << 10, F.concat(F.floor(size / (1 << 10)), F.lit(" KB"))).otherwise(F.concat(size, F.lit(" B")))


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    """(p0, p1, dist, len, ave_us, rate) of white-space tables; blank and # lines are skipped."""
    cells = F.split(F.trim("value"), r"\s+")
    names = (("p0", "int"), ("p1", "int"), ("dist", "int"), ("len", "int"), ("ave_us", "double"), ("rate", "double"))
    return spark.read.text(path).where("trim(value) <> '' and not trim(value) like '#%'").select(*(cells[i].cast(t).alias(c) for i, (c, t) in enumerate(names)))


def transfer_fit(transfers: DataFrame) -> DataFrame:
    """T(L) = setup + L * per_byte, by least squares."""
    return transfers.agg(F.round(F.regr_intercept("ave_us", "len"), 6).alias("setup_us"), F.round(F.regr_slope("ave_us", "len"), 9).alias("us_per_byte"))


def rounded_times(phases: DataFrame) -> DataFrame:
    """Milliseconds and seconds of microseconds, half up."""
    return phases.withColumn("ms", F.floor(F.col("us") / 1e3 + 0.5)).withColumn("s", F.floor(F.col("us") / 1e6 + 0.5))


class Profiler:
    """Wall time by phase; phases may be entered again and then add up. Materialise inside a phase, for plans are lazy."""

    def __init__(self) -> None:
        self.micros: dict[str, float] = defaultdict(float)
        self.open: set[str] = set()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        if name in self.open:
            raise RuntimeError(f"phase {name!r} is open already")
        self.open.add(name)
        began = time.perf_counter()
        try:
            yield
        finally:
            self.micros[name] += (time.perf_counter() - began) * 1e6
            self.open.discard(name)

    def report(self, spark: SparkSession, node: int = 0) -> DataFrame:
        return rounded_times(spark.createDataFrame([(k, node, int(v)) for k, v in self.micros.items()], "phase string, node int, us long"))


def gathered(reports: list[DataFrame]) -> DataFrame:
    """The phases of all nodes in one table."""
    return reduce(DataFrame.unionByName, reports)


def phase_of(runs: DataFrame, phase: str, node: int | None = None) -> DataFrame:
    """The rows of one phase, of one node or of all."""
    return runs.where((F.col("phase") == phase) & (F.lit(True) if node is None else F.col("node") == node))


def chunk_grid(spark: SparkSession, rows: int, n: int, exponents: list[int]) -> DataFrame:
    """(calls, block, share): a table of so many rows, moved in so many calls of a block each, a share of it to each of n parts."""
    return spark.createDataFrame([(1 << e, rows >> e, (rows >> e) // n) for e in exponents], "calls long, block long, share long")


def chunk_sweep(spark: SparkSession, rows: int, n: int, calls: list[int]) -> DataFrame:
    """(operation, calls, us): wall time of moving a table of so many rows in so many calls: to one part, dealt to n, gathered from n, and
    all to all."""
    source = spark.range(rows).withColumn("part", (F.col("id") % n).cast("int")).persist()
    source.count()
    moves = {
        "send": lambda d: d.repartition(1), "scatter": lambda d: d.repartitionById(n, F.col("part")), "gather": lambda d: d.coalesce(1),
        "alltoall": lambda d: d.repartitionById(n, F.pmod(F.floor(F.col("id") / n), F.lit(n)).cast("int")),
    }
    out = []
    for count in calls:
        for name, move in moves.items():
            began = time.perf_counter()
            for i in range(count):
                move(source.where(F.col("id").between(rows * i // count, rows * (i + 1) // count - 1))).write.format("noop").mode("overwrite").save()
            out.append((name, count, int((time.perf_counter() - began) * 1e6)))
    source.unpersist()
    return spark.createDataFrame(out, "operation string, calls long, us long")
