"""Best-fit packing of token sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths (at most `capacity` counts) reaches the driver. There, all patterns of two or three present
lengths that fill a sequence exactly are enumerated (where at most a quarter of the lengths is present, those that fall a little short
too), repeat counts are fitted to the histogram by non-negative least squares and rounded to the nearest, and what is left over, or
no pattern holds, is packed best-fit, largest first, again as repeated patterns. A pattern's slot owns a run of the ranks that pieces
of its length have, so the plan's size depends on `capacity` alone, and each piece finds its place by its rank. Which of equally
long pieces gets which slot follows from their order in the table.

Null and empty texts are one piece: the separator. Repeated rows are packed each. Ranks come from counts by partition and length;
no group of equal lengths meets in one task. The pieces are written to the shared folder first, since ranks must not change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordovar.llm.bpe_transducer import transducer
from ordovar.llm.common import lean, small_batches, text_slices, written

CAPACITY = 2048
SEPARATOR = 0


def pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank): documents cut where they exceed capacity, the short piece first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for row, end, buf, offsets in text_slices(batch, "text"):
                ids, first = machine.ids(buf, offsets)
                owner, piece, start, length, crc = [], [], [], [], []
                for k in range(end - row):
                    own = np.append(ids[first[k] : first[k + 1]], SEPARATOR).astype("<u4")
                    n = len(own)
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        owner.append(row + k)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                run = size[order]
                begin = np.searchsorted(run, run, side="left")
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - begin + seen[run]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(rank)],
                    ["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(kernel), f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long").withColumnRenamed("id", id_col)


def patterns(hist: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Arrays of patterns of two and of three present lengths whose sum is capacity, or just below it where few lengths are present."""
    have = np.flatnonzero(hist[:capacity] > 0)
    have = have[have > 0]
    if not len(have):
        return []
    present = np.zeros(capacity + 1, bool)
    present[have] = True
    slack = 0 if len(have) > capacity // 4 else max(1, capacity // (8 + len(have)))
    out = []
    for gap in range(slack + 1):
        room = capacity - gap
        other = room - have
        ok = (other >= have) & present[other.clip(0)]
        out.append(np.stack([have[ok], other[ok]], 1))
        a, b = np.triu_indices(len(have))
        a, b = have[a], have[b]
        c = room - a - b
        ok = (c >= b) & present[c.clip(0)]
        out.append(np.stack([a[ok], b[ok], c[ok]], 1))
    pairs = np.concatenate([x for x in out if x.shape[1] == 2])
    triples = np.concatenate([x for x in out if x.shape[1] == 3])
    return [x for x in (pairs, triples) if len(x)]


def nnls(groups: list[np.ndarray], hist: np.ndarray, rounds: int = 200) -> list[np.ndarray]:
    """Repeat counts x >= 0 minimising the length-weighted squares of (uses of each length) - hist, by accelerated projected gradient."""
    n = len(hist)
    weight = np.arange(n) / n

    def uses(xs: list[np.ndarray]) -> np.ndarray:
        return sum((np.bincount(g[:, j], x, n) for g, x in zip(groups, xs, strict=True) for j in range(g.shape[1])), np.zeros(n))

    def back(r: np.ndarray) -> list[np.ndarray]:
        return [r[g].sum(1) for g in groups]

    v = [np.ones(len(g)) for g in groups]
    top = 1.0
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(weight**2 * uses(v))
        top = np.sqrt(sum(float(x @ x) for x in v)) or 1.0
        v = [x / top for x in v]
    step = 1 / (1.05 * top)
    x = [np.zeros(len(g)) for g in groups]
    y, t = x, 1.0
    for _ in range(rounds):
        grad = back(weight**2 * (uses(y) - hist))
        new = [np.maximum(0, a - step * g) for a, g in zip(y, grad, strict=True)]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = [a + (t - 1) / t2 * (a - b) for a, b in zip(new, x, strict=True)]
        x, t = new, t2
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go. Rows by (length, first rank): the pieces from that rank on, up to the next row's, go to the
    sequences from `sequence` on, one each, at `offset`. hist: pieces of length 0..capacity."""
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int]] = []
    sequences = 0

    def commit(lengths: list[int], repeat: int) -> None:
        nonlocal sequences
        at = 0
        for n in lengths:
            rows.append((n, int(used[n]), sequences, at))
            used[n] += repeat
            left[n] -= repeat
            at += n
        sequences += repeat

    if left[capacity]:
        commit([capacity], int(left[capacity]))
    groups = patterns(left, capacity)
    fitted = []
    for g, x in zip(groups, nnls(groups, left[: capacity + 1].astype(float)) if groups else [], strict=True):
        some = x >= 0.5
        fitted += zip(x[some].tolist(), g[some].tolist(), strict=True)
    for v, p in sorted(fitted, key=lambda f: (-f[0], f[1])):
        repeat = min(int(v + 0.5), *(int(left[n]) // p.count(n) for n in p))
        if repeat > 0:
            commit(p, repeat)
    while True:
        have = np.flatnonzero(left > 0)
        if not len(have):
            break
        lengths, count = [], {}
        room, top = capacity, len(have) - 1
        while top >= 0 and room >= have[0]:
            top = min(top, int(np.searchsorted(have, room, side="right")) - 1)
            while top >= 0 and count.get(int(have[top]), 0) >= left[have[top]]:
                top -= 1
            if top < 0:
                break
            n = int(have[top])
            lengths.append(n)
            count[n] = count.get(n, 0) + 1
            room -= n
        commit(lengths, min(int(left[n]) // c for n, c in count.items()))
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3], "sequences": np.array([sequences])}


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    own = written(df.sparkSession, pieces(df, vocabulary, capacity, id_col, text_col), "pieces")
    by_part = own.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in own.groupBy("length").count().collect():  # at most capacity rows
        hist[r["length"]] = r["count"]
    made = plan(hist, capacity)
    wide = 1 << 44
    keys = made["length"] * wide + made["rank"]
    firsts, sequences, offsets = made["rank"], made["sequence"], made["offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = np.asarray(b.column("rank"))
            row = np.searchsorted(keys, np.asarray(b.column("length")) * wide + rank, side="right") - 1
            names = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequences[row] + rank - firsts[row]), pa.array(offsets[row])], [*names, "sequence_id", "offset"])

    placed = own.join(bases, ["part", "length"]).select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    kind = placed.schema["id"].dataType.simpleString()
    return placed.mapInArrow(lean(place), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
