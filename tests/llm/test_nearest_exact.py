"""op5_nearest_neighbours gives what its SQL gives, also over several blocks, with copies and with numbers of any size.

Scores of float vectors are equal to the last bit; of double vectors to nine digits, since the SQL fuses products and sums.
"""

import math

import duckdb
import numpy as np
import pytest

from ordovar.llm import ann, queries
from ordovar.llm.common import table


def by_sql(path):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}'")
    return sorted(con.sql(queries.ORACLE["op5_nearest_neighbours"]).fetchall(), key=repr)


def nine_digits(rows):
    return sorted((*r[:3], repr(float(f"{r[3]:.9g}") + 0.0)) if math.isfinite(r[3]) else (*r[:3], repr(r[3])) for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    got = queries.op5_nearest_neighbours(spark, d)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(f"{d}/embeddings.parquet")
    e = table(spark, d, "embeddings")
    cut = ann.search(e, e.where("vec_id % 20 = 0"), block_vectors=150, block_queries=9)
    assert sorted(map(tuple, cut.collect()), key=repr) == by_sql(f"{d}/embeddings.parquet")


def test_copies_and_odd_numbers_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(11)
    near = [v.tolist() for v in rng.standard_normal((30, 5))]
    vectors = [near[i % 30] for i in range(240)]  # eight copies of each: ties at every rank
    vectors += [(rng.standard_normal(5) * 10.0 ** rng.integers(-6, 7)).tolist() for _ in range(60)]
    vectors += [[-1.0, 0.0, 0.0, 0.0, 0.0], [0.0, -1.0, 0.0, 0.0, 0.0]]
    vectors += [[0.0] * 5, [-0.0] * 5, None, [], [1.0, None, 1.0, 1.0, 1.0], [float("inf")] + [1.0] * 4, [float("nan")] * 5]
    rows = [(i, v) for i, v in zip(rng.permutation(len(vectors)).tolist(), vectors, strict=True)]
    rows += [(-20, near[0]), (None, near[1])]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    got = sorted(map(tuple, queries.op5_nearest_neighbours(spark, str(tmp_path)).collect()), key=repr)
    assert got == by_sql(f"{path}/*.parquet")


@pytest.mark.parametrize("factor", [1e150, 1.0, 1e-170, 1e-320])
def test_products_near_the_ends_of_doubles_equal_sql(spark, tmp_path, factor):
    rng = np.random.default_rng(12)
    vectors = (rng.uniform(-1, 1, (120, 4)) * factor).tolist() + rng.uniform(0.1, 1, (40, 4)).tolist()
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(path)
    got = queries.op5_nearest_neighbours(spark, str(tmp_path)).collect()
    assert nine_digits(map(tuple, got)) == nine_digits(by_sql(f"{path}/*.parquet"))


def test_products_beyond_doubles_end():
    x = np.random.default_rng(12).uniform(-1, 1, (160, 4)) * np.repeat([1e200, 1.0], 80)[:, None]
    ids = np.arange(160)
    assert all(len(places) >= 20 for places, _, _ in ann.Lines(x, 20).exact(x[::20], 20, ids[::20], ids))


def test_exact_search_verifies_few():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12_000, 48)) * rng.uniform(0.8, 1.2, (12_000, 1))
    asked, ids = np.arange(0, 12_000, 100), np.arange(12_000)
    verified = 0
    for i, (places, score, seen) in zip(asked, ann.Lines(x, 20).exact(x[asked], 20, asked, ids), strict=True):
        verified += seen
        s = np.where(ids == i, -np.inf, x @ x[i])
        assert places[np.lexsort((places, -score))][:20].tolist() == np.lexsort((ids, -s))[:20].tolist()
    assert verified <= 0.1 * len(asked) * 12_000
