"""The queries and the pipeline's stages against plain Python over the whole of a small table, and the SQL of those that have it."""

import glob
import itertools
import math
import os
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ordovar.llm import decontam, langid, queries, toxicity
from ordovar.llm.common import crc_mod, table

D = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, D, "documents").collect()


# -- SQL


def normal(v):
    return (float(f"{v:.9g}") if not math.isnan(v) else "nan") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE) - {"op5_nearest_neighbours"}))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(queries.ORACLE[name])
    cols = sorted(want.columns)
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == cols
    rows = lambda it, at: sorted((tuple(normal(r[at(c)]) for c in cols) for r in it), key=repr)
    assert rows(df.collect(), lambda c: c) == rows(want.fetchall(), want.columns.index)


# -- language


def grams(text):
    """Counts of 1- to 3-grams of lower-case letters; 1 is a word edge, a letter its code point + 2, shorter grams have zeros before."""
    s = [1]
    for c in text or "":
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            s.append(ord(low if len(low) == 1 else c) + 2)
        elif s[-1] != 1:
            s.append(1)
    s += [1] if s[-1] != 1 else []
    out = Counter((0, 0, a) for a in s if a > 1)
    out.update((0, a, b) for a, b in itertools.pairwise(s) if a > 1 or b > 1)
    out.update((a, b, c) for a, b, c in zip(s, s[1:], s[2:], strict=False) if b > 1)
    return out


def ranked(count, size):
    return sorted(count, key=lambda g: (-count[g], g))[:size]


def language_of(text, profiles):
    top = ranked(grams(text), langid.TEXT_SIZE)
    if not top:
        return "und", 0.0
    size = langid.PROFILE_SIZE
    sums = {lang: sum(min(abs(p[g] - i), size) if g in p else size for i, g in enumerate(top)) for lang, p in profiles.items()}
    best = min(sums, key=lambda lang: (sums[lang], lang))
    return best, 1 - sums[best] / (size * len(top))


def profiles_of(docs):
    total = {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            total.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    return {lang: {g: i for i, g in enumerate(ranked(c, langid.PROFILE_SIZE))} for lang, c in total.items()}


def test_languages_are_the_nearest_profiles(spark, docs):
    profiles = profiles_of(docs)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in queries.op1_language_id(spark, D).collect()}
    want = {r["doc_id"]: (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1, *language_of(r["text"], profiles)) for r in docs}
    assert got == {i: (h, lang, round(x, 9)) for i, (h, lang, x) in want.items()}


# -- toxicity


def dense_neighbours(model, texts, text):
    """(ids, cosines) of the k nearest by a dense product, ties to the smaller id."""

    def vector(t):
        out = np.zeros(len(model.number))
        for term, n in Counter(re.findall(r"[^\W\d_]+", t.lower())).items():
            if term in model.number:
                out[model.number[term]] = (1 + math.log(n)) * model.idf[model.number[term]]
        return out / (np.linalg.norm(out) or 1.0)

    rows = np.array([vector(texts[i]) for i in model.index.ids]).reshape(-1, len(model.number))
    cosine = np.round(rows @ vector(text or ""), 12)
    near = np.lexsort((model.index.ids, -cosine))[: model.k]
    near = near[cosine[near] > 0]
    return model.index.ids[near].tolist(), cosine[near], model.index.labels[near]


def toxic_score(model, texts, text):
    ids, cosine, label = dense_neighbours(model, texts, text)
    if not ids:
        return ids, model.base
    w = 1 / (0.1 + np.maximum(0, 1 - cosine))
    vote = min(max((w @ label + 0.1 * model.base) / (w.sum() + 0.1), 1e-3), 1 - 1e-3)
    return ids, 1 / (1 + math.exp(-(model.slope * math.log(vote / (1 - vote)) + model.shift)))


def test_toxicity_neighbours_are_those_of_a_dense_product(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs.where(crc_mod("doc_id", 5) != 0), table(spark, d, "labels"))
    assert len(model.index.ids) > model.k
    tied = 0
    for r in toxicity.score(docs, model).select("doc_id", "score", "evidence").collect():
        ids, score = toxic_score(model, texts, texts[r["doc_id"]])
        assert [e["id"] for e in r["evidence"]] == ids and abs(r["score"] - score) < 1e-9
        tied += len({e["cosine"] for e in r["evidence"]}) < len(ids)
    assert tied  # ties among the neighbours did occur


# -- decontamination


def bench_words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if w]


def windows_of(items):
    out = {}
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            out.setdefault(tuple(w[k : k + 10]), set()).add(i)
    return out


def hit(text, wins):
    w, places, items = bench_words(text), set(), set()
    for n in {len(k) for k in wins}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                places.update(range(i, i + n))
                items |= wins[tuple(w[i : i + n])]
    return len(w), len(places), items


def test_both_ways_of_decontamination_find_the_same(spark):
    rows = [(1, "a b c d e f g h i j k l m"), (2, "x x x x x x x x x x x x"), (3, "p q a b c d e f g h i j z a b c d e f g h i j k"), (4, None), (5, "Short One"), (6, "one short one"), (6, "one short one"), (None, "short one two")]
    bench = spark.createDataFrame([(10, "A b c d e f g h i j k"), (11, "x x x x x x x x x x x"), (12, "short one"), (13, None), (14, "short one")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (repr(r["__id"]), [tuple(s) for s in r["spans"]], sorted(r["items"]))
    one, other = (sorted(map(key, decontam.hits(df, bench, broadcast_limit=n).collect())) for n in (0, 200_000))
    assert one == other and one
    wins = windows_of([(10, "A b c d e f g h i j k"), (11, "x x x x x x x x x x x"), (12, "short one"), (14, "short one")])
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontam.report(df, bench).collect())
    assert got == sorted((repr(i), n, h, sorted(s)) for i, t in rows for n, h, s in [hit(t, wins)])


# -- the pipeline


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def smallest_of_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    kept, groups = [], []
    for i in sorted(sets):
        mine = [g for g in groups if any(sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in g)]
        merged = sorted([i, *itertools.chain(*mine)])
        groups = [g for g in groups if g not in mine] + [merged]
    kept = {g[0] for g in groups}
    return [(i, t) for i, t in rows if i in kept]


def test_every_stage_of_the_pipeline_rejects_what_brute_force_rejects(spark):
    import corpus_pipeline as c

    D = "/root/testdata/sf0.01"  # fewer rows have too few toxic examples
    docs = table(spark, D, "documents").collect()

    junk = [(900_001, "".join(chr(97 + (i * i * 7919 + i * 31) % 26) for i in range(900))), (900_002, "x" * 500), (900_003, "12 34 !!"), (900_004, None), (900_005, "")]
    item = next(r["text"] for r in table(spark, D, "benchmark").collect() if r["text"] and len(bench_words(r["text"])) >= 10)
    extra = [*junk, (900_006, f"{docs[0]['text']} {item}"), (900_007, docs[1]["text"] + " and"), (900_008, docs[1]["text"])]
    schema = table(spark, D, "documents").schema
    made = [tuple({**{f.name: None for f in schema}, "doc_id": i, "text": t}.values()) for i, t in extra]
    rows = spark.createDataFrame([*map(tuple, docs), *made], schema)
    profiles = profiles_of(docs)
    stages = dict(c.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    said = {i: language_of(t, profiles) for i, t in [(r["doc_id"], r["text"]) for r in docs] + extra}
    want = sorted(i for i, (lang, x) in said.items() if lang != "und" and x >= c.MIN_LANGUAGE_SCORE)
    kept = stages["language"](spark, rows, D)
    assert kept.columns == rows.columns and ids(kept) == want and not {i for i, _ in junk} & set(want) and {r["doc_id"] for r in docs} <= set(want)

    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    model = toxicity.fit(kept.where(crc_mod("doc_id", 5) != 0), table(spark, D, "labels"))
    clean = stages["toxicity"](spark, kept, D)
    assert len(model.index.ids) and len(ids(clean)) < len(text)
    assert ids(clean) == sorted(i for i, t in text.items() if toxic_score(model, text, t)[1] < 0.5)

    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = stages["near_dedup"](spark, clean, D)
    want = smallest_of_groups(left)
    assert sorted((r["doc_id"], r["text"]) for r in single.collect()) == sorted(want) and not {900_007, 900_008} & {i for i, _ in want}

    wins = windows_of([(r["item_id"], r["text"]) for r in table(spark, D, "benchmark").collect()])
    last = stages["decontamination"](spark, single, D)
    assert ids(last) == sorted(i for i, t in want if not hit(t, wins)[1]) and 900_006 not in ids(last)
    assert sorted(r["doc_id"] for r in stages["packing"](spark, last, D).where("piece = 0").collect()) == ids(last)


def test_the_pipeline_takes_nulls_and_empty_tables(spark, docs):
    import corpus_pipeline as c

    schema = table(spark, D, "documents").schema
    for rows in ([], [tuple(None for _ in schema)] * 3, [*map(tuple, docs[:30]), tuple({**{f.name: None for f in schema}, "text": docs[40]["text"]}.values())]):
        df = spark.createDataFrame(rows, schema)
        for _, stage in c.STAGES[:-1]:
            df = stage(spark, df, D)
            assert df.schema.names == schema.names
        assert df.where("doc_id is null").count() == (len(rows) > 3)
        assert c.STAGES[-1][1](spark, df, D).where("doc_id is null and piece = 0").count() == (len(rows) > 3)
