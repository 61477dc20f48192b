"""Nearest neighbours by collision counting on single projections, with an exact check.

Each vector is projected on `projections` lines, random rotations of orthogonal ones; each line keeps its projections sorted. A query
opens on each line a window centred on its own projection, WIDTH times as wide on either side as the search radius. A vector at the
radius lies in each window with probability P(|N| < WIDTH); one that is in at least the share of windows that such a vector reaches
with probability `recall` collides often enough and is verified by its exact inner product. The radius grows until the k-th best
of the verified vectors is within it (virtual rehashing: the sorted arrays stay, windows only open further at both ends, and the
counts of what they held before are kept). Inner products become distances by one more coordinate that lifts all vectors to the
longest one's length.

Counting alone misses some of the k nearest. The check that follows finds these: on the lines of one rotation squared differences add up
to the squared distance, so a vector whose sum over some of them exceeds the k-th best's is none of the k nearest. Lines are added
until few vectors are left, and these are verified too. The k nearest are exact then, in every block and so over all, and their scores
are sums in the order of the components, as a loop over them gives.

Vectors are dealt to blocks of bounded size, each with its own arrays, and meet the queries in blocks too; a query's best k over the
blocks remain. Only where vectors are few do the blocks of queries shrink, so that all cores have work. What a block finds does not
depend on which other queries it gets.

Null ids, null or empty vectors, zero vectors and vectors with null or non-finite components take no part; vectors of another
dimension are no candidates. Repeated rows are candidates each; ties go to the smaller id. Fewer than k candidates: all of them. Empty
tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 160
#: Half a window's width in radii: where counts of near and of far vectors lie farthest apart.
WIDTH = 1.31
#: Of vectors exactly at the radius; of the k nearest, which are mostly nearer, counting finds some 0.96.
RECALL = 0.8
#: The check adds so many lines at a time, for so many queries at once, until at most this share of the vectors is left.
CHECK_LINES = 16
CHECK_QUERIES = 64
CHECK_LEFT = 0.01
BLOCK_VECTORS = 16_000
BLOCK_QUERIES = 10_000
#: Vectors of a block whose own neighbours tell where its radii start.
PROBES = 24


def _usable(vec: str) -> Column:
    return F.expr(f"size({vec}) > 0 and not exists({vec}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({vec}, x -> x <> 0)")


def _scaled(x: np.ndarray) -> np.ndarray:
    """x times a power of two, below 1: products neither overflow nor all vanish."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with q, added to 0 from the first component to the last; equal rows have equal ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.add.accumulate(x * q, axis=1)[:, -1] + 0.0  # no -0.0


class Lines:
    """The sorted projections of one block."""

    def __init__(self, x: np.ndarray, k: int, projections: int = PROJECTIONS, recall: float = RECALL):
        self.original, self.n, self.lines = x, len(x), projections
        self.x = x = _scaled(x)
        length = np.einsum("ij,ij->i", x, x)
        self.top = float(length.max())
        lift = np.sqrt(np.maximum(0, self.top - length))
        d = x.shape[1] + 1
        rng = np.random.default_rng([d, projections])
        turns = [np.linalg.qr(rng.standard_normal((d, d)))[0] * np.sqrt(d) for _ in range(-(-projections // d))]
        self.axes = np.concatenate(turns, 1)[:, :projections]
        values = np.ascontiguousarray((x @ self.axes[:-1] + lift[:, None] * self.axes[-1]).T)
        self.turn = values[:d].copy()  # of one rotation, by place
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.uint16)
        self.sorted = np.take_along_axis(values, self.order.astype(np.int64), 1)
        self.rank = np.empty(self.order.shape, np.uint16)
        np.put_along_axis(self.rank, self.order.astype(np.int64), np.broadcast_to(np.arange(self.n, dtype=np.uint16), self.order.shape), 1)
        self.kind = np.uint8 if projections < 256 else np.uint16
        hit = math.erf(WIDTH / math.sqrt(2))
        self.least = max(1, math.ceil(projections * (hit - NormalDist().inv_cdf(recall) * math.sqrt(hit * (1 - hit) / projections))))
        self.first = self._first_radius(k)

    def _first_radius(self, k: int) -> float:
        """Where the search may start: below the distance of the k-th neighbour of most of some of the block's vectors."""
        q = np.stack([self._asked(v) for v in self.original[:: max(1, self.n // PROBES)][:PROBES]])
        s = np.partition(self.x @ q.T, max(0, self.n - k - 1), axis=0)[max(0, self.n - k - 1)]
        return 0.98 * float(np.quantile(np.sqrt(np.maximum(2 * self.top - 2 * s, 1e-6 * self.top)), 0.25))

    def _ends(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        lo = np.array([v.searchsorted(p) for v, p in zip(self.sorted, at - half, strict=True)], np.int64)
        hi = np.array([v.searchsorted(p, "right") for v, p in zip(self.sorted, at + half, strict=True)], np.int64)
        return lo, hi

    def _opened(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many windows [lo, hi) of ranks each vector is."""
        out = np.zeros(self.n, self.kind)
        for line, a, b in zip(self.rank, lo.tolist(), hi.tolist(), strict=True):
            if b - a >= self.n:
                out += 1
            elif b > a:
                out += (line - np.uint16(a)) < np.uint16(b - a)
        return out

    def _widened(self, counts: np.ndarray, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds what the windows' new parts hold."""
        begin, end = np.concatenate([new[0], old[1]]), np.concatenate([old[0], new[1]])
        size = end - begin
        line = np.tile(np.arange(self.lines), 2) * self.n + begin
        at = np.repeat(line - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        counts += np.bincount(self.order.ravel()[at], minlength=self.n).astype(self.kind)

    def _asked(self, q: np.ndarray) -> np.ndarray:
        """The query, of the longest vector's length."""
        q = _scaled(q)
        return q * (np.sqrt(self.top) / np.sqrt(q @ q))

    def nearest(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, inner products with the query of the longest vector's length) of the k best that counting finds and what ties with
        the last, and how many were verified; skip: places that don't count."""
        q = self._asked(q)
        at = q @ self.axes[:-1]
        k = min(k, self.n - int(skip.sum()))
        if k == 0:
            return np.zeros(0, np.int64), np.zeros(0), 0
        radius = self.first
        reach = float(np.abs(self.sorted[:, [0, -1]] - at[:, None]).max()) / WIDTH
        window = self._ends(at, WIDTH * radius)
        counts = self._opened(*window)
        places, score, seen = np.zeros(0, np.int64), np.zeros(0), skip.copy()
        while True:
            more = np.flatnonzero((counts >= self.least) & ~seen)
            seen[more] = True
            places, score = np.concatenate([places, more]), np.concatenate([score, self.x[more] @ q])
            far = np.inf
            if len(places) >= k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                # |x - q|^2 of the lifted, equally long vectors
                far = math.sqrt(max(0.0, 2 * self.top - 2 * kth))
            if far <= radius or radius > reach:  # beyond the reach, all windows cover all
                break
            radius = max(1.01 * radius, min((radius + far) / 2, 1.2 * radius))
            wider = self._ends(at, WIDTH * radius)
            self._widened(counts, window, wider)
            window = wider
        near = score >= kth - 1e-9 * self.top
        return places[near], score[near], len(places)

    def _left(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which vectors (columns) may lie within the squared distances `far` of the queries (rows) at these projections."""
        d = len(self.axes)  # lines are longer than unit vectors by its root
        limit = d * (far + 1e-9 * self.top)[:, None]
        total, left = np.zeros((len(at), self.n)), np.ones((len(at), self.n), bool)
        for i in range(0, len(self.turn), CHECK_LINES):
            v, p = self.turn[i : i + CHECK_LINES], at[:, i : min(i + CHECK_LINES, len(self.turn))]
            total += (p * p).sum(1)[:, None] + (v * v).sum(0) - 2 * (p @ v)
            left = total <= limit
            if left.mean() <= CHECK_LEFT:
                break
        return left

    def exact(self, asked: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (row; its id in own) places and inner products of the k nearest and what may tie with the last, and how many
        were verified: what counting finds, and of the others those that the check doesn't rule out."""
        peak = np.abs(self.original).max()
        for begin in range(0, len(asked), CHECK_QUERIES):
            some = asked[begin : begin + CHECK_QUERIES]
            skips = [ids == i for i in own[begin : begin + CHECK_QUERIES]]
            found = [self.nearest(q, k, skip) for q, skip in zip(some, skips, strict=True)]
            at = np.stack([self._asked(q) for q in some]) @ self.axes[:-1]
            # without k candidates all were found, and the check has nothing to add
            far = np.array([2 * self.top - 2 * (np.sort(score)[-k] if len(score) >= k else np.inf) for _, score, _ in found])
            for q, skip, (near, _, verified), left in zip(some, skips, found, self._left(at, far), strict=True):
                with np.errstate(over="ignore", under="ignore"):
                    if not 1e-300 < peak * np.abs(q).max() < 1e300 / len(q):  # products may leave the range of doubles, where any may tie
                        left = True
                more = np.setdiff1d(np.flatnonzero(left & ~skip), near, assume_unique=True)
                places = np.concatenate([near, more])
                yield places, _products(self.original[places], q), verified + len(more)


def search(base: DataFrame, queries: DataFrame, k: int = 20, projections: int = PROJECTIONS, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k nearest of base by inner product, itself (its id) excepted; exact."""
    if not 0 < block_vectors <= 60_000 or not 0 < projections < 65_536:
        raise ValueError("a block has at most 60000 vectors, on at most 65535 lines")
    name = lambda df, a, b: df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias(a), F.col(vec_col).cast("array<double>").alias(b)).where(_usable(b))
    rows, asked = name(base, "id", "v"), name(queries, "q", "w")
    # the number of blocks leaves room for uneven hashing: no block reaches 65536 vectors
    n, m = rows.count(), asked.count()
    nb = max(1, -(-n // block_vectors))
    nq = max(1, -(-m // block_queries), min(-(-m // 100), -(-2 * base.sparkSession.sparkContext.defaultParallelism // nb)))
    cells = lambda df, own, n, key, other, m: df.withColumn(key, F.pmod(F.xxhash64(own, F.monotonically_increasing_id()), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = cells(rows, "id", nb, "b", "c", nq).select(F.size("v").alias("d"), F.col("b").cast("int").alias("b"), F.col("c").cast("int").alias("c"), "id", "v")
    right = cells(asked, "q", nq, "c", "b", nb).select(F.size("w").alias("d"), F.col("b").cast("int").alias("b"), F.col("c").cast("int").alias("c"), "q", "w")

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if x.num_rows and y.num_rows:
            dense = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            # in the order of ids, so that the arrays don't depend on the order of arrival
            x = x.sort_by("id")
            ids = x.column("id").to_numpy()
            lines, qs = Lines(dense(x, "v"), k, projections, recall), y.column("q").to_numpy()
            for q, (places, score, _) in zip(qs, lines.exact(dense(y, "w"), k, qs, ids), strict=True):
                best = np.lexsort((ids[places], -score, ~np.isnan(score)))[:k]  # products that overflow to NaN come first, as in SQL
                out_q.append(np.full(len(best), q))
                out_i.append(ids[places][best])
                out_s.append(score[best])
        cat = lambda a, t: pa.array(np.concatenate(a) if a else np.zeros(0), t)
        return pa.table({"query_id": cat(out_q, pa.int64()), "id": cat(out_i, pa.int64()), "score": cat(out_s, pa.float64())})

    found = left.groupBy("d", "b", "c").cogroup(right.groupBy("d", "b", "c")).applyInArrow(cell, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
