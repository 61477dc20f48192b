"""A hidden Markov language model: Baum-Welch over the whole corpus, exact likelihoods by the scaled forward recursion.

A state emits a word class, a class emits its words alike in every state. Classes are the `top` most frequent words, one each, the end
of a text, and RARE classes of all other words by their last two bytes; inside a rare class a word has probability
(c + 1) / (tokens + words + 1) of the class, and a word that training lacks (1) / (the same). So the model's tables are bounded
(`states` x classes) and travel with the tasks, while the counts of all words of the corpus stay in a table that texts join.

`top` grows with the training vocabulary up to TOP, so that a partition's expected counts stay a few MB.

Training: expected counts of each partition are summed across partitions in blocks, until a round gains less than GAIN of the log
likelihood, or ROUNDS are done. Texts of more than SEGMENT tokens are worked on in segments side by side: the transfer matrices of
the segments say what comes into each and what follows it, so that counts and likelihoods are those of the whole text.

Null and empty texts are the end token alone. Rows with null id train. Repeated rows train and are scored each. Without training
rows, every token is unknown. Words are told apart by 64-bit hashes; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordovar.llm.common import LOWER, text_slices, word_hashes, word_spans, written

STATES = 8
TOP = 32_000
#: Words that occur less often share the rare classes at any size, so that these show what is left for words that training lacks.
OFTEN = 3
RARE = 509
ROUNDS = 5
GAIN = 0.005
SEGMENT = 1024
LANE_TOKENS = 300_000


def rare_class(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0..RARE-1 by the last two bytes of each word."""
    last = low[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)
    return (last * 257 + before) % RARE


def word_counts(df: DataFrame, is_training: Column, text_col: str = "text") -> DataFrame:
    """(hash, rare, c) of all words of the training rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch, "text"):
                low = LOWER[buf]
                starts, ends, _ = word_spans(low, offsets)
                h, first, c = np.unique(word_hashes(low, starts, ends), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rare_class(low, starts[first], ends[first]).astype(np.int32)), pa.array(c.astype(np.int64))], ["hash", "rare", "c"])

    rows = df.where(is_training & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, "hash long, rare int, c long").groupBy("hash", "rare").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """top: the frequent words' hashes, sorted, and their counts; class numbers: their places, then the rare classes, then the end."""

    top: np.ndarray
    top_count: np.ndarray
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    texts: int
    tokens: int
    words: int

    @property
    def classes(self) -> int:
        return len(self.top) + RARE + 1

    def base(self, c: np.ndarray | float) -> np.ndarray:
        return np.log10((np.asarray(c, float) + 1) / (self.tokens + self.words + 1))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of every token with the ends, each text's first token, hashes)."""
        low = LOWER[buf]
        starts, ends, first = word_spans(low, offsets)
        h = word_hashes(low, starts, ends).view(np.int64)
        at = np.searchsorted(self.top, h)
        known = at < len(self.top)
        known[known] = self.top[at[known]] == h[known]
        cls = np.where(known, at, len(self.top) + rare_class(low, starts, ends)).astype(np.uint16)
        n = len(offsets) - 1
        out = np.full(len(cls) + n, self.classes - 1, np.uint16)
        place = np.arange(len(cls)) + np.searchsorted(first, np.arange(len(cls)), side="right") - 1
        out[place] = cls
        return out, first + np.arange(n + 1), h


def vocabulary(counts: DataFrame, texts: int, top: int = TOP) -> Vocabulary:
    head = counts.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "hash").limit(top).select("hash", "c").collect()  # at most `top` pairs of numbers
    head.sort(key=lambda r: r["hash"])
    hashes, c = np.array([r["hash"] for r in head], np.int64), np.array([r["c"] for r in head], np.int64)
    tokens, words = np.zeros(RARE), np.zeros(RARE)
    for r in counts.groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # RARE rows
        tokens[r["rare"]], words[r["rare"]] = r["c"], r["n"]
    total, distinct = int(tokens.sum()) + texts, int(words.sum()) + (texts > 0)
    if head:
        mine = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(h),) for h in hashes], "hash long")), "hash").groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
        for r in mine:
            tokens[r["rare"]] -= r["c"]
            words[r["rare"]] -= r["n"]
    return Vocabulary(hashes, c, tokens, words, texts, total, distinct)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def first_guess(prior: np.ndarray, states: int) -> Hmm:
    """Sticky moves, and class frequencies that are spread over the states unevenly, so that these part in few rounds; fixed by a seed, so
    that every run trains the same model."""
    rng = np.random.default_rng(states)
    emit = (prior + 1e-9)[:, None] * (rng.gamma(0.3, 1, (len(prior), states)) + 0.02)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Lanes:
    """Segments of texts, longest first, and what is around each: the state probabilities before it (None: the text starts), the
    likelihood of what follows by its last state (None: nothing does)."""

    begin: np.ndarray
    size: np.ndarray
    opens: np.ndarray
    before: np.ndarray
    after: np.ndarray


def _lanes(cls: np.ndarray, first: np.ndarray, model: Hmm, segment: int) -> Iterator[Lanes]:
    """All segments, in groups of bounded size."""
    k = len(model.start)
    size = np.diff(first)
    pieces = np.maximum(1, -(-size // segment))
    owner = np.repeat(np.arange(len(size)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[owner] + place * segment
    lens = np.minimum(segment, first[owner + 1] - begin)
    opens, before, after = place == 0, np.ones((len(owner), k)), np.ones((len(owner), k))
    cut = np.flatnonzero(pieces[owner] > 1)
    if len(cut):
        maps = np.empty((len(cut), k, k))
        order = np.argsort(-lens[cut], kind="stable")
        for at in range(0, len(order), 1024):
            part = cut[order[at : at + 1024]]
            maps[order[at : at + 1024]], _ = _transfers(cls, begin[part], lens[part], opens[part], model)
        v = model.start
        for j, i in enumerate(cut):
            before[i] = v
            v = maps[j][0] if opens[i] else v @ maps[j]
            v = v / v.sum()
        for j in range(len(cut) - 2, -1, -1):
            if not opens[cut[j + 1]]:
                w = maps[j + 1] @ after[cut[j + 1]]
                after[cut[j]] = w / w.max()
    order = np.argsort(-lens, kind="stable")
    total = np.cumsum(lens[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LANE_TOKENS, side="right")))
        part = order[at:end]
        yield Lanes(begin[part], lens[part], opens[part], before[part], after[part])
        at = end


def expected(cls: np.ndarray, first: np.ndarray, model: Hmm, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the texts, and their log10 likelihood."""
    k = len(model.start)
    starts, moves, emits, loglik = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    for lane in _lanes(cls, first, model, segment):
        begin, size = lane.begin, lane.size
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        offset = np.concatenate([[0], np.cumsum(live)])
        tokens = np.concatenate([cls[begin[:m] + t] for t, m in enumerate(live)])
        b = model.emit[tokens]
        alpha = np.empty_like(b)
        scale = np.empty(len(tokens))
        entry = np.where(lane.opens[:, None], model.start, lane.before @ model.move)
        for t, m in enumerate(live):
            here = slice(offset[t], offset[t + 1])
            a = b[here] * (entry if t == 0 else alpha[offset[t - 1] : offset[t - 1] + m] @ model.move)
            scale[here] = a.sum(1)
            alpha[here] = a / scale[here, None]
        loglik += float(np.log10(scale).sum())
        b /= scale[:, None]
        post = np.empty_like(b)
        last = alpha[offset[size - 1] + np.arange(len(size))]
        beta = lane.after / (last * lane.after).sum(1)[:, None]
        for t in range(len(live) - 1, -1, -1):
            here = slice(offset[t], offset[t + 1])
            m = live[t]
            post[here] = alpha[here] * beta[:m]
            right = b[here] * beta[:m]
            if t:
                moves += alpha[offset[t - 1] : offset[t - 1] + m].T @ right
                beta[:m] = right @ model.move.T
            elif not lane.opens.all():
                inner = ~lane.opens
                moves += lane.before[inner].T @ right[inner]
        starts += post[: live[0]][lane.opens].sum(0)
        for s in range(k):
            emits[:, s] += np.bincount(tokens, post[:, s], len(emits))
    return starts, moves * model.move, emits, loglik


def forward(cls: np.ndarray, first: np.ndarray, model: Hmm, segment: int = SEGMENT) -> np.ndarray:
    """The exact log10 probability of each text's class sequence."""
    out = np.zeros(len(first) - 1)
    for lane in _lanes(cls, first, model, segment):
        alpha, total = np.empty((len(lane.begin), len(model.start))), np.zeros(len(lane.begin))
        entry = np.where(lane.opens[:, None], model.start, lane.before @ model.move)
        for t, m in enumerate(np.searchsorted(-lane.size, -np.arange(1, lane.size[0] + 1), side="right")):
            a = model.emit[cls[lane.begin[:m] + t]] * (entry if t == 0 else alpha[:m] @ model.move)
            s = a.sum(1)
            total[:m] += np.log10(s)
            alpha[:m] = a / s[:, None]
        np.add.at(out, np.searchsorted(first, lane.begin, side="right") - 1, total)
    return out


def _transfers(cls: np.ndarray, begin: np.ndarray, lens: np.ndarray, opens: np.ndarray, model: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """What each segment makes of each state before it, and the log10 of the scale taken out; in the rows of segments that open a text
    nothing is before. Segments come with falling lengths."""
    k = len(model.start)
    maps, total = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy(), np.zeros(len(begin))
    for t, m in enumerate(np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")):
        a = (maps[:m].reshape(-1, k) @ model.move).reshape(m, k, k)
        if t == 0:
            a[opens[:m]] = model.start
        a *= model.emit[cls[begin[:m] + t]][:, None, :]
        if t % 8 == 7 or t == lens[0] - 1 or m < len(begin):
            s = a.max((1, 2))
            a /= s[:, None, None]
            total[:m] += np.log10(s)
        maps[:m] = a
    return maps, total


def encoded(df: DataFrame, is_training: Column, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, train, classes): every row's class sequence, as 16-bit numbers; h: the text's hash."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in text_slices(batch, "text"):
                cls, first, _ = words.encode(buf, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in ("id", "h", "train")), pa.array([cls[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "h", "train", "classes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), is_training.alias("train"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, "id long, h long, train boolean, classes binary")


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint16), np.concatenate([[0], np.cumsum([len(r) // 2 for r in raw])]).astype(np.int64)


BLOCKS = 16


def baum_welch(seqs: DataFrame, words: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """The model, and each round's log10 likelihood before its step."""
    prior = np.concatenate([words.top_count, words.rare_tokens + 1, [words.texts + 1]]).astype(float)
    model, history = first_guess(prior / prior.sum(), states), []
    cells = states + states * states + 1 + len(prior) * states
    cut = -(-cells // BLOCKS)
    rows = seqs.where("train").select("classes")
    for _ in range(rounds):
        shared = seqs.sparkSession.sparkContext.broadcast(model)

        def counts(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros(cells), TaskContext.get().partitionId()
            for b in batches:
                if b.num_rows:
                    s, m, e, ll = expected(*_sequences(b.column("classes")), shared.value)
                    total += np.concatenate([s, m.ravel(), [ll], e.ravel()])
            # the partitions' sums travel in single precision, but for the likelihood and the moves in the first block
            parts = [total[i * cut : (i + 1) * cut] for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([p.astype(np.float32 if i else np.float64).tobytes() for i, p in enumerate(parts)], pa.binary()), pa.array(np.full(BLOCKS, part % 64, np.int32))], ["block", "part", "salt"])

        def summed(t: pa.Table) -> pa.Table:
            block, salt = t.column("block")[0].as_py(), t.column("salt")[0].as_py()
            kind = np.float32 if block and salt >= 0 else np.float64
            acc = 0.0
            for p in t.column("part"):
                acc = acc + np.frombuffer(p.as_buffer(), kind).astype(np.float64)
            return pa.table({"block": t.column("block")[:1], "part": pa.array([acc.tobytes()], pa.binary()), "salt": pa.array([-1], pa.int32())})

        kind = "block int, part binary, salt int"
        got = rows.mapInArrow(counts, kind).groupBy("block", "salt").applyInArrow(summed, kind).groupBy("block").applyInArrow(summed, kind).collect()  # one table of `cells` numbers
        if not got:
            break
        total = np.concatenate([np.frombuffer(r["part"]) for r in sorted(got, key=lambda r: r["block"])])
        s, m, ll, e = np.split(total, np.cumsum([states, states * states, 1]))
        history.append(float(ll[0]))
        settled = len(history) > 1 and history[-1] - history[-2] < GAIN * abs(history[-2])
        s, m, e = s + 1e-3, m.reshape(states, states) + 1e-3, e.reshape(-1, states)
        e = e + 0.1 * (prior / prior.sum())[:, None]  # so that every class keeps some probability everywhere
        model = Hmm(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))
        shared.unpersist()
        if settled:
            break
    return model, history


def score(df: DataFrame, is_training: Column, states: int = STATES, top: int = TOP, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = df.sparkSession
    counts = written(spark, word_counts(df, is_training, text_col), "counts")
    words = vocabulary(counts, df.where(is_training).count(), top)
    seqs = written(spark, encoded(df, is_training, words, id_col, text_col), "sequences")
    model, _ = baum_welch(seqs, words, states, rounds)
    shared = spark.sparkContext.broadcast((words, model))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        n_top = len(words.top)
        end = float(words.texts)
        of = np.concatenate([words.base(words.top_count), np.zeros(RARE), [words.base(end)]])
        known = np.concatenate([np.ones(n_top, np.int64), np.zeros(RARE, np.int64), [int(end > 0)]])
        for b in batches:
            cls, first = _sequences(b.column("classes"))
            cum = lambda v: np.add.reduceat(v, first[:-1]) if len(first) > 1 else v[:0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "h", "train")), pa.array(np.diff(first)), pa.array(cum(known[cls])), pa.array(cum(of[cls])), pa.array(forward(cls, first, model) if len(first) > 1 else np.zeros(0))], ["id", "h", "train", "n_tokens", "n_known", "base", "forward"])

    near = seqs.mapInArrow(local, "id long, h long, train boolean, n_tokens long, n_known long, base double, forward double")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = shared.value
        for batch in batches:
            for row, end, buf, offsets in text_slices(batch, "text"):
                cls, first, h = words.encode(buf, offsets)
                owner = np.repeat(np.arange(end - row), np.diff(first))
                inner = np.ones(len(cls), bool)
                inner[first[1:] - 1] = False
                cls, owner = cls[inner].astype(np.int64) - len(words.top), owner[inner]
                keep = cls >= 0
                who = pa.array(owner[keep])
                ids, texts = batch.column("id").slice(row, end - row), batch.column("h").slice(row, end - row)
                yield pa.RecordBatch.from_arrays([ids.take(who), texts.take(who), pa.array(h[keep]), pa.array(cls[keep].astype(np.int32))], ["id", "h", "hash", "rare"])

    # equal rows share their sums: each is looked up once
    once = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    copies = seqs.groupBy("id", "h").agg(F.count("*").alias("copies"))
    asked = once.mapInArrow(rare, "id long, h long, hash long, rare int")
    sizes = F.broadcast(spark.createDataFrame([(i, float(t + w + 1)) for i, (t, w) in enumerate(zip(words.rare_tokens, words.rare_words, strict=True))], "rare int, size double"))
    c = F.coalesce(F.col("c"), F.lit(0))
    found = asked.join(counts.select("hash", "c"), "hash", "left").join(sizes, "rare")
    sums = found.groupBy("id", "h").agg(F.sum(F.log10((c + 1) / F.lit(float(words.tokens + words.words + 1)))).alias("b"), F.sum(F.log10((c + 1) / F.col("size"))).alias("s"), F.sum((c > 0).cast("long")).alias("k"))
    sums = sums.join(copies, sums["id"].eqNullSafe(copies["id"]) & (sums["h"] == copies["h"])).select(sums["id"].alias("i2"), sums["h"].alias("h2"), (F.col("b") / F.col("copies")).alias("b"), (F.col("s") / F.col("copies")).alias("s"), (F.col("k") / F.col("copies")).cast("long").alias("k"))
    out = near.join(sums, near["id"].eqNullSafe(sums["i2"]) & (near["h"] == sums["h2"]), "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("forward") + zero("s")).alias("score"))
