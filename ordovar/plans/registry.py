"""Queries of the sorting engine over the given tables. P is events, its unique id as the position, dealt evenly to eight parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordovar.functions import stencil
from ordovar.functions.intmath import ceil_log2, ceil_logk, is_power_of_two
from ordovar.operators import exchange, layout, merge, strategies, validate
from ordovar.plans import analytics
from ordovar.plans.fixtures import LOGS, TRANSFERS
from ordovar.sources import generator
from ordovar.spec import SortSpec

N = 8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def dealt(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """P: (part, pos, value)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("key"), F.col("user_id").alias("value"))
    return layout.scattered(events, "key", events.count(), n).select("part", "pos", "value")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _sort(algo: str) -> None:
    QUERIES[f"sort_{algo}"] = lambda spark, sf_dir: strategies.sort(dealt(spark, sf_dir), SortSpec(algo, N, sigma=(0, 4, 0)))


for _a in strategies.ALGORITHMS:
    _sort(_a)


def _long(df: DataFrame) -> DataFrame:
    """Part numbers as long, as the other engine has them."""
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


@query
def scatter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(dealt(spark, sf_dir).groupBy("part").agg(F.count("*").alias("cnt"), F.min("pos").alias("displ")))


@query
def scatterv_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in four slices: a quarter, none, half, the rest."""
    rows = dealt(spark, sf_dir).select("pos", "value").persist()
    m = rows.count()
    counts = [m // 4, 0, m // 2, m - m // 4 - m // 2]
    return _long(layout.scattered_by(rows, counts, [sum(counts[:i]) for i in range(4)]).select("part", "local_pos", "value"))


@query
def gatherv_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of uneven size, one after the other: part = value modulo 8."""
    rows = dealt(spark, sf_dir).withColumn("part", (F.col("value") % N).cast("int"))
    return exchange.gatherv(layout.local_rank(rows, keys=("pos",), name="local_pos"))


@query
def local_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(layout.local_rank(dealt(spark, sf_dir)).select("part", "i", "value"))


@query
def local_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(layout.local_splitters(layout.local_rank(dealt(spark, sf_dir)), N))


@query
def global_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = strategies.splitters_of(dealt(spark, sf_dir), N)
    return spark.createDataFrame(list(enumerate(got)), "idx long, splitter long")


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(spark, sf_dir)
    return p.withColumn("bucket", layout.bucket_of(F.col("value"), strategies.splitters_of(p, N)))


@query
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(layout.histogram(_bucketed(spark, sf_dir)))


@query
def count_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part receives of each other."""
    hist = layout.histogram(_bucketed(spark, sf_dir)).groupBy("bucket").pivot("part", list(range(N))).agg(F.sum("cnt"))
    return hist.select(F.col("bucket").cast("long").alias("part"), *(F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"from_{i}") for i in range(N)))


@query
def send_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = layout.histogram(_bucketed(spark, sf_dir))
    return _long(layout.displacements(layout.displacements(hist, "part", "bucket", "sdispl"), "bucket", "part", "rdispl"))


@query
def fixed_range_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 143151 % (1 << 31)).alias("value"))
    return _long(keys.withColumn("bucket", layout.width_bucket_of(F.col("value"), 1 << 31, N)).groupBy("bucket").agg(F.count("*").alias("cnt")))


def _round(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: _long(layout.local_rank(make(dealt(spark, sf_dir))).select("part", "i", "value"))


for _t in range(1, 4):
    for _m in (0, 1):
        _round(f"mergesort_round_{_t}_map_{_m}", lambda df, t=_t, m=_m: strategies.merge_round(df, N, strategies.merge_dest(F.col("part"), N, t - 1, m)))
    _round(f"lbmerge_round_{_t}", lambda df, t=_t: strategies.merge_round(df, N, strategies.lb_dest(F.col("part"), F.col("value"), strategies.splitters_of(df, N), N, t)))
for _t in (1, 2):
    _round(f"kmerge_round_{_t}", lambda df, t=_t: strategies.merge_round(df, N, strategies.kmerge_dest(F.col("part"), N, t - 1, 4)))


def _bitonic(df: DataFrame, rounds: int) -> DataFrame:
    slots = strategies.largest_part(df)
    for mask, bit in strategies.bitonic_rounds(N)[:rounds]:
        df = strategies.bitonic_round(df, N, mask, bit, slots)
    return df


for _t in range(1, 7):
    _round(f"bitonic_round_{_t}", lambda df, t=_t: _bitonic(df, t))


def _level(levels: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = dealt(spark, sf_dir)
        cuts = strategies.pivots_of(df, levels)
        df = df.withColumn("node", F.lit(0))
        for level in cuts:
            df = strategies.quicksort_level(df, level)
        return _long(df.select("node", "pos", "value"))

    QUERIES[f"quicksort_level_{levels}"] = run


for _t in range(1, 4):
    _level(_t)


@query
def alltoall_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part in eight blocks, of an eighth of the largest part's rows."""
    rows = layout.local_rank(dealt(spark, sf_dir), keys=("pos",), name="local_pos").persist()
    return _long(exchange.alltoall(rows, -(-strategies.largest_part(rows) // N)))


@query
def alltoallv_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bucketed(spark, sf_dir)
    displs = layout.displacements(layout.histogram(rows), "bucket", "part", "rdispl")
    placed = rows.withColumn("k", (F.row_number().over(Window.partitionBy("part", "bucket").orderBy("value", "pos")) - 1).cast("long"))
    return _long(exchange.alltoallv(placed, displs))


@query
def sendrecv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(exchange.sendrecv(dealt(spark, sf_dir), 1).groupBy("part").agg(F.count("*").alias("cnt"), F.sum("value").alias("total")))


@query
def sendrecv_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part's rows the first half stays, and of the rest as many as half a part, from the first quarter on, go to the partner."""
    rows = layout.local_rank(dealt(spark, sf_dir), keys=("pos",), name="local_pos").select("part", "local_pos", "value")
    c = F.col("c")
    slices = rows.groupBy("part").agg(F.count("*").alias("c")).withColumn("partner", F.col("part").bitwiseXOR(F.lit(1)).cast("int"))
    sizes = slices.select(F.col("part").alias("partner"), F.col("c").alias("other"))
    slices = slices.join(sizes, "partner").select("part", "partner", F.floor(c / 4).alias("sdispl"), F.floor(c / 2).alias("scount"), F.floor(F.col("other") / 2).alias("rdispl"), F.floor(c / 2).alias("keep"))
    return _long(exchange.sendrecv_slices(rows, slices))


@query
def gather_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.local_rank(dealt(spark, sf_dir), keys=("value", "pos"), name="local_pos").persist()
    return exchange.gather(rows, strategies.largest_part(rows))


@query
def bcast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(exchange.bcast(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("value")), N))


@query
def receive_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part receives of its neighbour's rows, behind its own."""
    rows = layout.local_rank(dealt(spark, sf_dir), keys=("pos",), name="local_pos").select("part", "local_pos", "value")
    return _long(exchange.appended(rows, exchange.sendrecv(rows, 1)))


@query
def phase_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases of three nodes in one table."""
    made = [analytics.rounded_times(spark.createDataFrame([("sorting", i, 1000 * i + 499), ("spd", i, 1_500_000 * i)], "phase string, node int, us long")) for i in range(3)]
    return _long(analytics.gathered(made))


@query
def compare_split_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(merge.compare_split(_pairs(spark, sf_dir), "low"))


@query
def compare_split_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(merge.compare_split(_pairs(spark, sf_dir), "high"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of even against odd keys, by region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    side = lambda odd: F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == odd, F.col("n_nationkey").cast("long"))))
    return n.groupBy(F.col("n_regionkey").alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))


@query
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by region of customers' nations merge into segments' orders."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("group"), F.col("c_nationkey").cast("long").alias("run"), F.col("c_acctbal").alias("value"))
    return merge.kway_merge(c)


@query
def double_keys_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of a double key with negative values and a payload."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_acctbal", "c_custkey")
    return layout.positioned(c, "c_acctbal", N, ("c_custkey",)).select("pos", "c_acctbal", "c_custkey")


@query
def timestamp_keys_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of order dates, ties by key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").cast("long").alias("day"), "o_orderkey")
    return layout.positioned(o, "day", N, ("o_orderkey",)).select("pos", "day", "o_orderkey")


@query
def is_sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows as they are dealt and as they are sorted: how many stand below the one before, and whether none does."""
    rows = dealt(spark, sf_dir).persist()
    said = lambda df, name: validate.inversions(df).agg(F.count("*").alias("inversions")).select(F.lit(name).alias("what"), "inversions", (F.col("inversions") == 0).alias("is_sorted"))
    return said(rows, "dealt").unionByName(said(strategies.sort(rows, SortSpec("samplesort", N)), "sorted"))


@query
def first_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.inversions(dealt(spark, sf_dir)).agg(F.min(F.struct("pos", "before", "value")).alias("x")).select("x.*")


@query
def multiset_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.checksum(strategies.sort(dealt(spark, sf_dir), SortSpec("bitonicsort", N)))


def _runs(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame([(f, i, x) for f, text in LOGS.items() for i, x in enumerate(text.split("\n"))], "file string, line_no long, line string")
    return analytics.with_dimensions(analytics.parse_logs(lines))


@query
def phase_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark)


@query
def phase_avg_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.averages(analytics.baseline_everywhere(_runs(spark)))


@query
def phase_pivot_nxta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pivoted(phase_avg_by_n(spark, sf_dir), "n", "algo", ["samplesort", "sequential"])


@query
def phase_pivot_mxtn(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.pivoted(phase_avg_by_n(spark, sf_dir).where("algo = 'samplesort'"), "m", "n", [2, 4])
    return got.select("m", F.col("2").alias("n_2"), F.col("4").alias("n_4"))


@query
def phase_pivot_nxtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.pivoted(phase_avg_by_n(spark, sf_dir).where("algo = 'samplesort'"), "n", "m", [1024, 2048])
    return got.select("n", F.col("1024").alias("m_1024"), F.col("2048").alias("m_2048"))


@query
def phase_pivot_mxta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pivoted(phase_avg_by_n(spark, sf_dir).where("n = 4"), "m", "algo", ["samplesort", "sequential"])


@query
def phase_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.phase_of(_runs(spark), "sorting")


@query
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.chunk_grid(spark, 1 << 23, N, list(range(14)))


@query
def token_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(stencil.token_owners(spark, 16))


@query
def phase_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.skew(_runs(spark))


@query
def campaign_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.campaign(spark, 3, list(range(20, 31)), [1, 2, 4, 8, 16], 3, ["sequential", *(a for a in strategies.ALGORITHMS if not a.startswith("sequential"))])


@query
def bytes_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 40).select(F.expr("shiftleft(1L, cast(id as int))").alias("size")).withColumn("human", analytics.humanised(F.col("size")))


@query
def math_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, ceil_log2(n), ceil_logk(n, 4), is_power_of_two(n)) for n in range(1, 130)], "n long, log2 long, log4 long, power boolean")


@query
def tsend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.transfer_fit(spark.createDataFrame(TRANSFERS, "len long, ave_us double"))


for _a, _m, _k in (("mergesort", 0, 2), ("mergesort", 1, 2), ("quicksort", 0, 2), ("quicksort", 1, 2), ("kmerge", 0, 4), ("bitonicsort", 0, 2), ("lbmergesort", 0, 2)):
    QUERIES[f"stencil_{_a}_{_m}"] = lambda spark, sf_dir, a=_a, m=_m, k=_k: _long(stencil.stencil(spark, 16, a, m, k))


@query
def algorithm_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.efficiency(spark, [2, 4, 8, 16, 32, 64, 128], [2, 4, 8])


@query
def items_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of each part in braces, elided where there are more than ten."""
    rows = layout.local_rank(dealt(spark, sf_dir), keys=("pos",)).where("i < 11")
    items = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"].cast("string"))
    text = rows.groupBy("part").agg(items.alias("v"))
    return _long(text.select("part", F.concat(F.lit("{"), F.array_join(F.slice("v", 1, 10), ","), F.when(F.size("v") > 10, ",...}").otherwise("}")).alias("items")))


@query
def jkiss_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.generate(spark, 100_000, 1)


@query
def jkiss_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.generate(spark, 100_000, 2, modulus=100)


@query
def sort_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's keys through fixed-width buckets of the whole range of keys."""
    rows = generator.generate(spark, 100_000, 3).withColumn("part", layout.share_of(F.col("pos"), 100_000, N))
    return strategies.bucketsort(rows, SortSpec("bucketsort", N), 1 << 31)
