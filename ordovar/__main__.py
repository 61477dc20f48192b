"""python -m ordovar -M rows -s seed -a strategy [-n parts] [-1 mapping] [-2 fan-in] [-o folder]: generate, sort, check, report."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ordovar.operators import layout, strategies, validate
from ordovar.plans.analytics import Profiler
from ordovar.sources.generator import cached, generate, table_name
from ordovar.spec import SortSpec


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ordovar", description=__doc__)
    parser.add_argument("-M", type=int, required=True, help="rows")
    parser.add_argument("-s", type=int, required=True, help="seed")
    parser.add_argument("-a", required=True, choices=sorted(strategies.ALGORITHMS), help="strategy")
    parser.add_argument("-n", type=int, default=8, help="parts")
    for i in (1, 2, 3):
        parser.add_argument(f"-{i}", dest=f"sigma{i}", type=int, default=(0, 4, 0)[i - 1], help=f"parameter {i}")
    parser.add_argument("-o", help="folder of data sets and results")
    parser.add_argument("-V", action="version", version="ordovar 0.1")
    args = parser.parse_args(argv)
    spec = SortSpec(args.a, args.n, args.M, args.s, (args.sigma1, args.sigma2, args.sigma3)).checked(set(strategies.ALGORITHMS))
    if args.M < args.n:
        parser.error("there must be at least as many rows as parts")
    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).getOrCreate()
    profiler = Profiler()
    with profiler.phase("scattering"):
        source = (cached(spark, args.o, args.M, args.s) if args.o else generate(spark, args.M, args.s)).withColumn("part", layout.share_of(F.col("pos"), args.M, args.n)).persist()
        source.count()
    with profiler.phase("spd"):
        done = strategies.sort(source, spec).persist()
        done.count()
    bad = validate.inversions(done).count()
    same = validate.checksum(done).first() == validate.checksum(source).first()
    if args.o and not bad and same:  # what fails the check is not stored
        done.write.mode("overwrite").parquet(f"{args.o}/{table_name(args.M, args.s, args.a)}")
    profiler.report(spark).show(truncate=False)
    print("sorted" if not bad else f"{bad} inversions", "permutation" if same else "rows differ")
    return int(bool(bad) or not same)


if __name__ == "__main__":
    raise SystemExit(main())
