"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting takes at most `examples` labelled rows, those with the smallest hash of their id (all, if there are fewer): the one bounded
sample. The vocabulary are all of the sample's terms that mark label 1 (log-likelihood ratio of presence against label, so high that half
a term is expected by chance). Near-equal texts of one label say nothing anew: each such group counts once, in the ratio, the document
frequencies and the rate of label 1, so that many copies of a text do not make terms of its words.
The sample's TF-IDF vectors form an inverted index in blocks of documents, with the largest weight of each term in each block. A
query visits blocks in falling order of the bound that these give and stops where no block can reach its k nearest any more, so the
k nearest are exact. Their labels, weighted by closeness, give a vote; a logistic curve fitted to the leave-one-out votes of the
sample turns it into a probability. The neighbours are the evidence.

Texts without a vocabulary term, null and empty ones included, score the rate of label 1 among such examples, groups counting once. Rows with a null label
or text do not train; an id with several labels counts as 1 if any is 1. Ties among neighbours go to the smaller id. Without any
labelled row every score is 0. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordovar.llm import neardup
from ordovar.llm.common import drop_path, lean, small_batches, written

EXAMPLES = 10_000
NEIGHBOURS = 15
BLOCK = 256
#: Results that a task keeps for texts with the same vector.
REMEMBERED = 4096
#: Terms that may be expected to pass by chance.
BY_CHANCE = 0.5

_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


@dataclass
class Index:
    """Block-max inverted index. doc: postings' documents, by term; block_at: first posting of each term in each block."""

    ids: np.ndarray
    labels: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    block_at: np.ndarray
    block_max: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        blocks = -(-len(ids) // BLOCK)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        doc = np.repeat(np.arange(len(ids)), [len(v[0]) for v in vectors])
        order = np.lexsort((doc, term))
        term, weight, doc = term[order], weight[order], doc[order]
        cell = term * blocks + doc // BLOCK
        block_at = np.searchsorted(cell, np.arange(n_terms * blocks + 1))
        block_max = np.zeros(n_terms * blocks)
        np.maximum.at(block_max, cell, weight)
        return Index(ids, labels, doc, weight, block_at, block_max.reshape(n_terms, blocks))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, cosines) of the k nearest with a cosine over 0, ties to the smaller place; leave: a document that is not one."""
        blocks = self.block_max.shape[1]
        bound = np.round(weight @ self.block_max[term], 12)  # like the cosines, so that what is equal ties
        best_doc, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1]):
                break
            if len(best) == k and bound[b] == best[-1] and b * BLOCK > best_doc[-1]:
                continue  # at best ties, which go to the smaller place
            score = np.zeros(BLOCK)
            for t, w in zip(term, weight, strict=True):
                lo, hi = self.block_at[t * blocks + b], self.block_at[t * blocks + b + 1]
                score[self.doc[lo:hi] - b * BLOCK] += w * self.weight[lo:hi]
            if leave // BLOCK == b:
                score[leave % BLOCK] = 0
            score = np.round(score, 12)
            hit = np.flatnonzero(score >= best[-1] if len(best) == k else score > 0)
            docs, scores = np.concatenate([best_doc, hit + b * BLOCK]), np.concatenate([best, score[hit]])
            order = np.lexsort((docs, -scores))[:k]
            best_doc, best = docs[order], scores[order]
        return best_doc, best


@dataclass
class Model:
    number: dict[str, int]
    idf: np.ndarray
    index: Index
    base: float
    slope: float
    shift: float
    k: int

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted((self.number[t], n) for t, n in counts.items() if t in self.number)
        term = np.array([p[0] for p in pairs], dtype=np.int64)
        w = (1 + np.log([p[1] for p in pairs])) * self.idf[term] if pairs else np.zeros(0)
        return term, w / (np.sqrt(w @ w) or 1.0)

    def vote(self, docs: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (0.1 + np.maximum(0, 1 - cosine))
        return float((w @ self.index.labels[docs] + 0.1 * self.base) / (w.sum() + 0.1))

    def curve(self, vote: float) -> float:
        v = min(max(vote, 1e-3), 1 - 1e-3)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift))))

    def judge(self, text: str | None, known: dict[bytes, tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
        """The calibrated score, and the neighbours' places and cosines. known: results by vector, for texts that share one."""
        term, w = self.vector(Counter(t for t in terms(text) if t in self.number))
        key = term.tobytes() + w.tobytes()
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            docs, cosine = self.index.nearest(term, w, self.k)
            known[key] = self.curve(self.vote(docs, cosine)) if len(docs) else self.base, docs, cosine
        return known[key]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """The calibrated score and the neighbours as (id, cosine, label)."""
        value, docs, cosine = self.judge(text, {})
        return value, [(int(self.index.ids[d]), float(c), int(self.index.labels[d])) for d, c in zip(docs, cosine, strict=True)]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with a weak pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(a, 0.05)), float(b)


def _files(df: DataFrame) -> set[str]:
    return {os.path.dirname(f) for f in df.inputFiles()}


def _groups(rows: DataFrame) -> tuple[dict[int, int], np.ndarray, set[str]]:
    """(group of each id in rows, label of each group, folders to drop): rows of one label whose texts are near-equal are a group."""
    near = neardup.near_duplicates(rows.select("id", "text"), id_col="id")
    component: dict[int, int] = {}
    for r in near.select("id", "component_id").collect():  # at most `examples` ids
        component[r["id"]] = min(r["component_id"], component.get(r["id"], r["component_id"]))
    number: dict[tuple[int, int], int] = {}
    group = {r["id"]: number.setdefault((component[r["id"]], r["label"]), len(number)) for r in rows.select("id", "label").distinct().collect()}
    return group, np.array([label for _, label in number], dtype=np.int64), _files(near)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """docs: the rows that may train; labels: (id, label)."""
    small_batches(docs.sparkSession)
    told = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pool = told.select(F.col(id_col).alias("id"), "label")
    sample = pool.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(examples)
    chosen = sample.sparkSession.createDataFrame(sample.collect(), sample.schema)  # at most `examples` pairs of numbers
    rows = written(docs.sparkSession, texts.join(F.broadcast(chosen), "id"), "examples")
    group, group_label, spent = _groups(rows)
    times = Counter(group.values())
    several = {i: g for i, g in group.items() if times[g] > 1}

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked, sets = Counter(), Counter(), {}
        for b in batches:
            for i, text, label in zip(b.column("id").to_pylist(), b.column("text"), b.column("label").to_pylist(), strict=True):
                own = set(terms(text.as_py()))
                if i in several:
                    sets.setdefault((several[i], label), set()).update(own)
                    continue
                seen.update(own)
                if label:
                    marked.update(own)
        found = [(None, t, n, marked[t]) for t, n in seen.items()]
        found += [(g, t, 1, label) for (g, label), own in sets.items() for t in own]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], kind) for j, kind in enumerate(kinds)], ["g", "term", "df", "df1"])

    n, n1 = len(group_label), int(group_label.sum())
    n0 = n - n1
    # what a group's rows hold counts once, wherever they lie; rows of no group are added up
    once = lambda col: F.when(F.col("g").isNull(), F.sum(col)).otherwise(F.max(col)).alias(col)
    counts = rows.select("id", "text", "label").mapInArrow(lean(presence), "g long, term string, df long, df1 long").groupBy("g", "term").agg(once("df"), once("df1"))
    counts = counts.groupBy("term").agg(F.sum("df").cast("double").alias("df"), F.sum("df1").cast("double").alias("df1"))
    a, c = F.col("df1"), F.col("df") - F.col("df1")

    def part(cell: Column, of: Column, total: float) -> Column:
        return F.when(cell > 0, cell * F.log(cell * float(n) / (of * total))).otherwise(0.0)

    ratio = 2 * (part(a, F.col("df"), n1) + part(c, F.col("df"), n0) + part(n1 - a, n - F.col("df"), n1) + part(n0 - c, n - F.col("df"), n0))
    found = []
    if n0 and n1:
        tried = counts.count()
        least = 2 * float(np.log(max(2, tried) / BY_CHANCE))
        found = counts.withColumn("ratio", ratio).where((F.col("ratio") >= least) & (a * n0 > c * n1)).orderBy(F.desc("ratio"), "term").collect()
    number = {r["term"]: i for i, r in enumerate(found)}
    idf = np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in found])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [Counter(t for t in terms(text) if t in number) for text in (t.as_py() for t in b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))], ["id", "label", "term", "tf"])

    kind = rows.schema["id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(lean(vectors), f"id {kind}, label int, term array<string>, tf array<int>").collect(), key=lambda r: r["id"])
    for path in spent | _files(rows):
        drop_path(docs.sparkSession, path)
    model = Model(number, idf, Index.build(np.zeros(0, np.int64), np.zeros(0), [], len(number)), 0.0, 1.0, 0.0, k)
    if not got:
        return model
    plain = [group_label[g] for g in {group[r["id"]] for r in got if not r["term"]}]
    model.base = (sum(plain) + 0.5 * n1 / n) / (len(plain) + 0.5)
    got = [r for r in got if r["term"]]
    vecs = [model.vector(Counter(dict(zip(r["term"], r["tf"], strict=True)))) for r in got]
    y = np.array([float(r["label"]) for r in got])
    model.index = Index.build(np.array([r["id"] for r in got], dtype=np.int64), y, vecs, len(number))
    votes = []
    for i, (t, w) in enumerate(vecs):
        docs_, cosine = model.index.nearest(t, w, k, leave=i)
        votes.append(model.vote(docs_, cosine) if len(docs_) else model.base)
    v = np.clip(np.array(votes), 1e-3, 1 - 1e-3)
    if len(v) and 0 < y.sum() < len(y):
        model.slope, model.shift = _logistic(np.log(v / (1 - v)), y)
    elif len(v):
        model.slope, model.shift = 1.0, 0.0
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those of `keep`) with score and evidence. The model is broadcast; `examples` bounds its size."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            out = [m.judge(t.as_py(), known) for t in b.column(text_col)]
            near = np.concatenate([np.zeros(0, np.int64), *(docs for _, docs, _ in out)]).astype(np.int64)
            cosine = np.concatenate([np.zeros(0), *(c for _, _, c in out)])
            ends = np.cumsum([0, *(len(docs) for _, docs, _ in out)]).astype(np.int32)
            found = [pa.array(m.index.ids[near], pa.int64()), pa.array(cosine), pa.array(m.index.labels[near].astype(np.int32))]
            said = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(found, ["id", "cosine", "label"]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([s for s, _, _ in out], pa.float64()), said], [*names, "score", "evidence"])

    rows = df.drop("score", "evidence")
    names = [f.name for f in rows.schema if keep is None or f.name in keep]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(lean(kernel), f"{kinds}, score double, evidence array<struct<id: long, cosine: double, label: int>>")
