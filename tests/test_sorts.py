"""All strategies agree on awkward keys; generator goldens; raw files; checks."""

import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from ordovar.functions import stencil
from ordovar.operators import layout, strategies, validate
from ordovar.plans import analytics
from ordovar.sources import generator, rawint
from ordovar.spec import SortSpec

BIG = 2**31 - 1
CASES = {
    "equal": [7] * 40, "sorted": list(range(33)), "reversed": list(range(40, 0, -1)), "duplicates": [random.Random(1).randrange(5) for _ in range(50)],
    "extremes": [BIG, -BIG - 1, 0, -1, 1, BIG, -BIG - 1, 5], "few": [3, 1, 2], "one": [4], "empty": [],
}


def rows(spark, values, n=8):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, value long")
    return df.withColumn("part", layout.share_of(F.col("pos"), len(values), n))


@pytest.mark.parametrize("case", CASES)
def test_all_strategies(spark, case):
    values = CASES[case]
    df = rows(spark, values).persist()
    for algo in strategies.ALGORITHMS:
        got = sorted(tuple(r) for r in strategies.sort(df, SortSpec(algo, 8)).select("pos", "value").collect())
        assert got == list(enumerate(sorted(values))), algo


@pytest.mark.parametrize("n", [1, 2, 3, 4, 16])
def test_any_number_of_parts(spark, n):
    values = [random.Random(n).randrange(100) for _ in range(37)]
    df = rows(spark, values, n).persist()
    for algo in ("samplesort", "bucketsort", "kmerge", "quicksort", "sequential1"):
        got = sorted(tuple(r) for r in strategies.sort(df, SortSpec(algo, n)).select("pos", "value").collect())
        assert got == list(enumerate(sorted(values))), algo


def test_nulls_first_and_nan_last(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, None, float("nan"), -1.0, None])], "id long, v double")
    got = [r["v"] for r in sorted(layout.positioned(df, "v", 4, ("id",)).collect(), key=lambda r: r["pos"])]
    assert got[:4] == [None, None, -1.0, 2.0] and got[4] != got[4]


def test_strict_mode():
    known = set(strategies.ALGORITHMS)
    for bad in (SortSpec("bitonicsort", 6, 60, strict=True), SortSpec("mergesort", 4, 7, strict=True), SortSpec("kmerge", 20, 20, strict=True), SortSpec("samplesort", 8, 3, strict=True), SortSpec("nope")):
        with pytest.raises(ValueError):
            bad.checked(known)
    assert SortSpec("kmerge", 32, 32, strict=True).checked(known).n == 32


GOLDEN = {1: ([1097409160, 277902303, 1656157321, 1901527586, 89671779, 688654946, 644685229, 1575353940], 1082258040431), 2: ([284995555, 21826929, 1441217514, 1344696990, 1924549953, 1392616608, 1594293816, 741933559], 1093802606377), 3: ([629694036, 1828172644, 26941865, 1549667829, 11453218, 195378909, 821215579, 1153502346], 1124731400364)}


@pytest.mark.parametrize("seed", GOLDEN)
def test_generator(spark, seed):
    first, total = GOLDEN[seed]
    v = generator.elements(seed, 0, 1024)
    assert v[:8].tolist() == first and int(v.sum(dtype="int64")) == total
    assert generator.elements(seed, 1000, 24, 5).tolist() == v[1000:].tolist()
    got = [r["value"] for r in sorted(generator.generate(spark, 1024, seed, 7).collect())]
    assert got == v.tolist()


def test_raw_files(spark, tmp_path):
    spark.dataSource.register(rawint.RawInt32)
    df = generator.generate(spark, 5000, 1, 3)
    df.select("pos", "value").write.format("rawint32").mode("append").save(str(tmp_path / "raw"))
    back = spark.read.format("rawint32").option("split_bytes", 4096).load(str(tmp_path / "raw"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_raw_files_append_and_overwrite(spark, tmp_path):
    spark.dataSource.register(rawint.RawInt32)
    path = str(tmp_path / "raw")
    write = lambda lo, hi, parts, mode: spark.range(lo, hi, 1, parts).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("value")).write.format("rawint32").mode(mode).save(path)
    back = lambda: [r["value"] for r in sorted(spark.read.format("rawint32").load(path).collect())]
    write(0, 100, 3, "append")
    write(100, 200, 2, "append")
    assert back() == list(range(200))
    write(5, 15, 1, "overwrite")
    assert back() == list(range(5, 15))
    with pytest.raises(Exception, match="nulls"):
        spark.createDataFrame([(0, 1), (1, None)], "pos long, value int").write.format("rawint32").mode("overwrite").save(path)
    assert back() == list(range(5, 15)) and not [f for f in os.listdir(path) if f.startswith(".")]
    write(0, 0, 1, "append")
    assert back() == list(range(5, 15))


def test_many_splitters_are_searched(spark):
    splitters = sorted(random.Random(2).randrange(10_000) for _ in range(1000))
    df = spark.createDataFrame([(v,) for v in [None, -1, 10_000, *splitters, *range(0, 10_000, 37)]], "v long")
    got = df.select("v", layout.bucket_of(F.col("v"), splitters).alias("b")).collect()
    assert all(r["b"] == (0 if r["v"] is None else bisect.bisect_left(splitters, r["v"])) for r in got)


def test_splitters_without_the_driver(spark):
    df = rows(spark, [random.Random(3).randrange(1000) for _ in range(700)])
    sample = layout.local_splitters(layout.local_rank(df), 8)
    assert layout.global_splitters(sample, 8, on_driver=0) == layout.global_splitters(sample, 8) != []


def test_sorted_input_gives_even_quicksort_parts(spark):
    df = spark.range(8000).select(F.col("id").alias("pos"), F.col("id").alias("value"), F.lit(0).alias("part"))
    nodes = df.withColumn("node", F.lit(0))
    for level in strategies.pivots_of(df, 3):
        nodes = strategies.quicksort_level(nodes, level)
    sizes = [r["count"] for r in nodes.groupBy("node").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1300


def test_command_line_and_profiler(spark, tmp_path, capsys, monkeypatch):
    from ordovar.__main__ import main

    for _ in range(2):  # generated, then read back
        assert main(["-M", "5000", "-s", "2", "-a", "lbkmergesort", "-n", "4", "-o", str(tmp_path)]) == 0
    assert "sorted permutation" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["-M", "3", "-s", "2", "-a", "samplesort"])
    monkeypatch.setattr(validate, "inversions", lambda df: df)  # a failed check stores nothing
    assert main(["-M", "500", "-s", "3", "-a", "quicksort", "-n", "4", "-o", str(tmp_path)]) == 1
    assert not (tmp_path / "M500_s3.quicksort.sorted").exists() and (tmp_path / "M5000_s2.lbkmergesort.sorted").exists()
    profiler = analytics.Profiler()
    with profiler.phase("a"), profiler.phase("b"), pytest.raises(RuntimeError), profiler.phase("a"):
        pass
    both = analytics.gathered([profiler.report(spark, 0), profiler.report(spark, 1)]).collect()
    assert sorted((r["phase"], r["node"]) for r in both) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_measurements(spark, tmp_path):
    (tmp_path / "t.gpl").write_text("# p0 p1\n\n0 1 1 4 60.5 0.1\n 0 1 1 8   61 0.2\n")
    assert [tuple(r) for r in analytics.read_transfers(spark, str(tmp_path / "t.gpl")).collect()] == [(0, 1, 1, 4, 60.5, 0.1), (0, 1, 1, 8, 61.0, 0.2)]
    swept = analytics.chunk_sweep(spark, 1000, 4, [1, 3]).collect()
    assert len(swept) == 8 and all(r["us"] > 0 for r in swept)
    assert "1 partitions, (id bigint)" in layout.described(spark.range(5).coalesce(1))


def test_checks(spark):
    bad = spark.createDataFrame([(0, 1), (1, 3), (2, 2), (3, 4), (4, 0)], "pos long, value long")
    assert sorted(tuple(r) for r in validate.inversions(bad, 2).collect()) == [(2, 3, 2), (4, 4, 0)]
    assert validate.checksum(bad).first() == validate.checksum(bad.orderBy("value")).first()
    assert validate.same_rows(bad, bad) and not validate.same_rows(bad, bad.limit(3))


def test_token_owners():
    assert [stencil.token_owner(i, 8, 1) for i in range(8)] == [0, 4, 2, 6, 1, 5, 3, 7]
