"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the `size` most frequent n-grams (1 to 3 letters, word edges marked) of all training texts of a language. A text's own
most frequent n-grams are ranked alike; each adds the difference of its ranks, or `size` where the profile lacks it. The least sum
wins, ties go to the smaller language code. The score is 1 minus the mean out-of-place distance over `size`.

Texts that are null or hold no letter are `und` with score 0, as are all texts if there is no training row. Ties between n-grams go
to the smaller code. Rows with a null language do not train. Further columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordovar.llm.bpe_transducer import LETTER, char_classes, code_points
from ordovar.llm.common import held, lean, small_batches, text_slices

PROFILE_SIZE = 400
TEXT_SIZE = 300
UNDETERMINED = "und"

#: Bytes of text that are counted at once; a longer text is counted by itself.
SLICE = 1 << 18


def _letter_codes() -> np.ndarray:
    """Code point -> lower-case code point + 1 of letters, else 0."""
    kinds = char_classes()
    lower = np.arange(0x110000, dtype=np.int32)
    for i in np.flatnonzero(kinds == LETTER):
        c = chr(i).lower()
        if len(c) == 1:
            lower[i] = ord(c)
    return np.where(kinds == LETTER, lower + 1, 0).astype(np.int32)


def letter_codes() -> np.ndarray:
    return held("letter codes", _letter_codes)


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, the text of each, in order of the text; their full codes): n-grams as small numbers that order as their full codes do."""
    lead, cp = code_points(buf)
    sym = letter_codes()[cp]
    owner = np.searchsorted(offsets, lead, side="right") - 1
    n = len(offsets) - 1
    # one edge before and after each text; runs of edges become one
    sym = np.concatenate([sym, np.zeros(2 * n, np.int32)])
    owner = np.concatenate([owner, np.arange(n), np.arange(n)])
    place = np.concatenate([np.arange(len(lead)) + 1, np.zeros(n, np.int64), np.full(n, len(lead) + 2)])
    order = np.lexsort((place, owner)) if n > 1 else np.argsort(place, kind="stable")
    sym, owner = sym[order], owner[order]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (owner[1:] != owner[:-1])
    sym, owner = sym[keep], owner[keep]
    letters, small = np.unique(sym, return_inverse=True)
    if len(letters) and letters[0] != 0:
        letters, small = np.concatenate([[0], letters]), small + 1
    base = len(letters) + 1
    wide = np.int64 if base**3 > 2**31 else np.int32
    s = small.astype(wide) + 1  # 0: no symbol, 1: word edge
    one = s > 1
    near = owner[1:] == owner[:-1]
    two = near & (one[1:] | one[:-1])
    three = near[1:] & near[:-1] & one[1:-1]
    g1, o1 = s[one], owner[one]
    g2, o2 = (s[:-1] * base + s[1:])[two], owner[:-1][two]
    g3, o3 = ((s[:-2] * base + s[1:-1]) * base + s[2:])[three], owner[:-2][three]
    ids, of = np.concatenate([g1, g2, g3]), np.concatenate([o1, o2, o3])
    order = np.argsort(of.astype(np.int32), kind="stable")
    full = np.concatenate([[0, 1], letters[1:].astype(np.int64) + 1])
    return ids[order], of[order], full


def full_code(ids: np.ndarray, full: np.ndarray) -> np.ndarray:
    """63-bit codes, alike in every batch: 21 bits a symbol."""
    base = len(full)
    return full[ids // (base * base)] << 42 | full[ids // base % base] << 21 | full[ids % base]


def train(df: DataFrame, is_training: Column, size: int = PROFILE_SIZE, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[int]]]:
    """[(language, its n-grams by rank)]. Counts cover all training rows; only `size` rows a language reach the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for row, end, buf, offsets in text_slices(batch, "text", SLICE):
                ids, of, full = grams(buf, offsets)
                own = langs[row:end]
                for lang in sorted(set(own)):
                    mine = ids[(own == lang)[of]]
                    if len(full) ** 3 <= 1 << 23:
                        n = np.bincount(mine)
                        got = np.flatnonzero(n)
                        n = n[got]
                    else:
                        got, n = np.unique(mine, return_counts=True)
                    codes = full_code(got.astype(np.int64), full)
                    if lang in total:
                        old, m = total[lang]
                        codes, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([m, n]), len(codes)).astype(np.int64)
                    total[lang] = codes, n
        for lang, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    small_batches(df.sparkSession)
    rows = df.where(is_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(lean(kernel), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top: dict[str, list[tuple[int, int]]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect():
        top.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return [(lang, [g for _, g in sorted(top[lang])]) for lang in sorted(top)]


def predict(df: DataFrame, profiles: list[tuple[str, list[int]]], size: int = PROFILE_SIZE, text_size: int = TEXT_SIZE, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those of `keep`) with lang_pred and score. The profiles (languages x size numbers) travel with the tasks."""
    small_batches(df.sparkSession)
    langs = [lang for lang, _ in profiles]
    known = np.unique(np.array([g for _, p in profiles for g in p], dtype=np.int64))
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for k, (_, p) in enumerate(profiles):
        ranks[k, np.searchsorted(known, np.array(p, dtype=np.int64))] = np.arange(len(p))

    def one(ids: np.ndarray, full: np.ndarray) -> tuple[str, float]:
        if not len(ids) or not langs:
            return UNDETERMINED, 0.0
        ids = np.sort(ids)
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        count = np.diff(np.concatenate([first, [len(ids)]]))
        ids = ids[first].astype(np.int64)
        if len(ids) > text_size:  # the most frequent, and all that tie with the last of them, in their order
            least = np.partition(count, len(count) - text_size)[len(count) - text_size]
            ok = count >= least
            ids, count = ids[ok], count[ok]
        top = ids[np.argsort(-count, kind="stable")[:text_size]]
        codes = full_code(top, full)
        at = np.searchsorted(known, codes)
        at[(at == len(known)) | (known[at.clip(max=len(known) - 1)] != codes)] = len(known)
        r = ranks[:, at]
        d = np.where(r < 0, size, np.minimum(np.abs(r - np.arange(len(top))), size)).sum(1)
        best = int(d.argmin())
        return langs[best], float(1 - d[best] / (size * len(top)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score = [], []
            for row, end, buf, offsets in text_slices(batch, text_col, SLICE):
                ids, of, full = grams(buf, offsets)
                cut = np.searchsorted(of, np.arange(end - row + 1))
                for k in range(end - row):
                    a, b = one(ids[cut[k] : cut[k + 1]], full)
                    said.append(a)
                    score.append(b)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(said, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    rows = df.drop("lang_pred", "score")
    names = [f.name for f in rows.schema if keep is None or f.name in keep]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(lean(kernel), f"{kinds}, lang_pred string, score double")
