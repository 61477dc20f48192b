"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of half-keys are made from few minhashes: `left` keys of 3 and `right` keys of 2. A table key is a pair of one left
and one right key, so left * right tables cost 3 * left + 2 * right minhashes, about the square root of what separate tables need.
With 18 and 12, a pair at the threshold of 0.75 shares a table with probability 0.9999.

Steps. (1) Equal shingle sets become one representative, the smallest id. (2) Left half-keys that nobody shares cannot be part of a
shared table key and go. (3) In each left bucket all members are compared, not with each other, but with its leader, the member whose
left keys are the most shared, if a right key of both is equal too: then they share a table, whose key is so formed where the left keys
meet. (4) Links that the full sets confirm give components. (5) Only left buckets that still hold several components are split into
their tables. A pair alone in a table is compared; what shares a larger one gets an exact search of its own, by prefixes: with shingles
ordered from rare to frequent, two sets that are similar enough share one of the first n - ceil(0.75 n) + 1. Pairs in different
components that do are compared; so no pair of a table is lost, and members that share only a frequent passage make no pairs: a
shingle's group is left out before any pair is formed when the sizes in it allow none. (6) Components of all links. Buckets are never
gathered: leaders come from pre-aggregated maxima, and the members of hot buckets are dealt to several tasks.

Rows without words have no shingles, link with nothing and are kept. Rows that share an id but not the set are judged each by its own
set; links of either are links of the id. Null ids link with nothing and are kept. Repeated rows are equal sets. Further columns are
ignored but for those of `carry`, which the result has too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordovar.llm.common import LOWER, drop_path, joined_hot, lean, mix64, stored, text_slices, word_hashes, word_spans, written
from ordovar.llm.components import components

WORDS = 5
PERCENT = 75
LEFT, LEFT_ROWS = 18, 3
RIGHT, RIGHT_ROWS = 12, 2

_RNG = np.random.default_rng(19970612)
_STEP = _RNG.integers(1, 2**63, WORDS * 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_N = LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS
_XOR = _RNG.integers(0, 2**63, _N, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after the other; each text's first place)."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offsets)
    h = word_hashes(low, starts, ends)
    n_words = np.diff(first)
    out, at = [], np.zeros(len(offsets), np.int64)
    if len(h) >= size:
        run = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            run += h[j : len(h) - size + 1 + j] * _STEP[j]
        run = mix64(run)
    for k, n in enumerate(n_words):
        a = first[k]
        if n >= size:
            own = np.unique(run[a : a + n - size + 1])
        elif n:
            own = mix64((h[a : a + n] * _STEP[size : size + n]).sum(dtype=np.uint64, keepdims=True) + np.full(1, n, np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        at[k + 1] = at[k] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at


def half_keys(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x LEFT, texts x RIGHT) 64-bit keys; texts without shingles have any."""
    n = len(at) - 1
    have = np.flatnonzero(np.diff(at) > 0)
    mins = np.zeros((_N, n), np.uint64)
    if len(have):
        for i in range(_N):
            mins[i, have] = np.minimum.reduceat((sets ^ _XOR[i]) * _MUL[i], at[have])
    cut = LEFT * LEFT_ROWS

    def keys(block: np.ndarray, rows: int) -> np.ndarray:
        block = block.reshape(-1, rows, n)
        acc = np.zeros((len(block), n), np.uint64)
        for j in range(rows):
            acc = mix64(acc + block[:, j] * _STEP[j])
        return mix64(acc + np.arange(1, len(block) + 1, dtype=np.uint64)[:, None] * _STEP[-1]).T

    with np.errstate(over="ignore"):
        return keys(mins[:cut], LEFT_ROWS), keys(mins[cut:], RIGHT_ROWS)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, n, f1, f2, lefts, rights, *carry): size and fingerprint of each row's shingle set, and its half-keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in text_slices(batch, "text"):
                sets, at = shingle_sets(buf, offsets)
                lefts, rights = half_keys(sets, at)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets, dtype=np.uint64)])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ _XOR[0]), dtype=np.uint64)])
                arrays = [
                    batch.column("id").slice(row, end - row), pa.array(np.diff(at)), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                    *(pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(k).view(np.int64).ravel())) for k in (lefts, rights)),
                    *(batch.column(c).slice(row, end - row) for c in kept),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "f1", "f2", "lefts", "rights", *kept])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    kept = rows.columns[2:]
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(lean(kernel), f"id long, n long, f1 long, f2 long, lefts array<long>, rights array<long>{kinds}")


#: Writes a table that later steps read, by a name.
Step = Callable[[DataFrame, str], DataFrame]


def left_buckets(reps: DataFrame, step: Step) -> DataFrame:
    """(key, rep, n, uses): the left keys that representatives share; uses: how many rows share any left key of this one."""
    rows = reps.select("rep", "n", F.explode("lefts").alias("key"))
    often = step(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("users", F.col("c")), "often")
    shared = joined_hot(rows, often, "key", LEFT * reps.count(), "rep")
    return shared.groupBy("rep", "n").agg(F.sum("users").alias("uses"), F.collect_list("key").alias("keys")).select(F.explode("keys").alias("key"), "rep", "n", "uses")


def star_pairs(table: DataFrame, reps: DataFrame, percent: int, step: Step) -> DataFrame:
    """Distinct pairs (a, b) of a left bucket's leader with its members, where a right key of both is equal too."""
    leaders = table.groupBy("key").agg(F.max(F.struct("uses", (-F.col("rep")).alias("back"), "n")).alias("top"), F.count("*").alias("c"))
    leaders = step(leaders.select("key", "c", (-F.col("top.back")).alias("lead"), F.col("top.n").alias("lead_n")), "leaders")
    star = joined_hot(table, leaders, "key", table.count(), "rep").where((F.col("rep") != F.col("lead")) & _alike("n", "lead_n", percent))
    rights = reps.select("rep", "rights")
    met = star.select("rep", "lead").distinct().join(rights.hint("merge"), "rep").join(rights.select(F.col("rep").alias("lead"), F.col("rights").alias("others")).hint("merge"), "lead").where(F.arrays_overlap("rights", "others"))
    return met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))


def unconnected(table: DataFrame, reps: DataFrame, comp: DataFrame, percent: int, step: Step) -> tuple[DataFrame, DataFrame]:
    """What shares a table with another component: pairs (a, b) that are alone in a table, and (rep, n, component) of all in larger ones.
    Of a left bucket of two, the leader's pair was all."""
    named = step(table.select("key", "rep", "n").join(comp.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
    ends = [F.min(F.struct("component", "rep", "n")).alias("lo"), F.max(F.struct("component", "rep", "n")).alias("hi"), F.count("*").alias("c")]
    total = table.count()
    mixed = step(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2").select("key", "c"), "mixed")
    open_ = joined_hot(named, mixed, "key", total, "rep").join(reps.select("rep", "rights").hint("merge"), "rep")
    tables = step(open_.select("key", "rep", "n", "component", F.explode("rights").alias("r")).select(F.xxhash64("key", "r").alias("key"), "rep", "n", "component"), "tables")
    split = step(tables.groupBy("key").agg(*ends).where("lo.component <> hi.component"), "split")
    two = split.where("c = 2").select(F.least("lo.rep", "hi.rep").alias("a"), F.greatest("lo.rep", "hi.rep").alias("b"), F.col("lo.n").alias("n"), F.col("hi.n").alias("m"))
    rest = joined_hot(tables, split.where("c > 2").select("key", "c"), "key", RIGHT * total, "rep").select("rep", "n", "component").distinct()
    return two.where(_alike("n", "m", percent)).select("a", "b").distinct(), rest


def _alike(a: str, b: str, percent: int) -> F.Column:
    """Sizes that a similarity of percent allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: (id, t)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for (_, _, x, ox), (_, _, y, oy) in zip(text_slices(batch, "ta", 0), text_slices(batch, "tb", 0), strict=True):  # row by row
                s, _ = shingle_sets(x, ox)
                t, _ = shingle_sets(y, oy)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    wide = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
    return wide.select("a", "b", "ta", "tb").mapInArrow(lean(kernel), "a long, b long").distinct()


def by_prefix(rest: DataFrame, texts: DataFrame, percent: int, step: Step) -> DataFrame:
    """Pairs (a, b) of rest (rep, n, component) in different components that can be similar enough, by the prefix rule."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in text_slices(batch, "t"):
                sets, at = shingle_sets(buf, offsets)
                who = pa.array(np.repeat(np.arange(row, end), np.diff(at)))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(who), pa.array(sets.view(np.int64))], ["rep", "shingle"])

    rows = texts.join(rest.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").select(F.col("id").alias("rep"), "t").mapInArrow(lean(kernel), "rep long, shingle long")
    total = rest.agg(F.sum("n")).first()[0] or 0
    often = step(rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").withColumn("df", F.col("c")), "shingles")
    # shingles of no other set come first and match nothing; what is left of the prefix is taken from the shared ones
    own = joined_hot(rows, often, "shingle", total, "rep").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s")).join(rest.hint("merge"), "rep")
    need = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - (F.col("n") - F.size("s")).cast("int")
    prefix = own.withColumn("m", F.size("s")).withColumn("need", need).where("need > 0")
    prefix = step(prefix.select("rep", "n", "component", "m", F.posexplode(F.slice("s", F.lit(1), F.col("need"))).alias("at", "x")).select("x.shingle", "rep", "n", "component", (F.col("m") - F.col("at")).alias("left")), "prefix")
    # the first shingle that two sets share, with all that follow it in the shorter rest, bounds what they can share; v, n of a group say whether any two can
    v = (100 + percent) * F.col("left") - percent * F.col("n")
    spans = step(prefix.groupBy("shingle").agg(F.max(v).alias("most"), F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi").drop("lo", "hi"), "spans")
    able = step(joined_hot(prefix, spans, "shingle", total, "rep").where((v >= percent * F.col("least")) & (F.col("most") >= percent * F.col("n"))).select("shingle", "rep", "n", "component", "left"), "able")
    x, y = able.alias("x"), able.alias("y")
    enough = F.least("x.left", "y.left") * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    cross = x.join(y.hint("merge"), F.col("x.shingle") == F.col("y.shingle")).where((F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _alike("x.n", "y.n", percent) & enough)
    return cross.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, n_shingles, component_id, kept, *carry) of every row."""
    spark = df.sparkSession
    spent = []

    def step(frame: DataFrame, name: str) -> DataFrame:
        out, path = stored(spark, frame, name)
        spent.append(path)
        return out

    own = written(spark, sketches(df, id_col, text_col, carry), "sketches")
    first = own.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "lefts", "rights")).alias("x"), F.count("*").alias("c"))
    reps = written(spark, first.select("f1", "f2", "n", "c", F.col("x.id").alias("rep"), "x.lefts", "x.rights"), "reps")
    table = step(left_buckets(reps, step), "buckets")
    pairs = step(star_pairs(table, reps, percent, step), "pairs")
    members = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    texts = step(members.join(table.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi"), "texts")
    links = step(confirmed(pairs, texts, percent), "links")
    comp = components(links)
    two, rest = unconnected(table, reps, comp, percent, step)
    more = step(by_prefix(step(rest, "rest"), texts, percent, step).union(two).distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        found = step(confirmed(more, texts, percent), "found")
        if not found.isEmpty():
            comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    for path in spent:  # what follows needs only sketches, representatives and components
        drop_path(spark, path)
    labels = reps.join(comp.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select("f1", "f2", "n", "c", F.coalesce("component", "rep").alias("component"))
    labels = written(spark, labels, "labels")
    named_rows = joined_hot(own.drop("lefts", "rights"), labels, ["f1", "f2", "n"], own.count(), "id", keep=True)
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(component)
    out = named_rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
