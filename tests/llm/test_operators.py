"""Each operator against brute force, exact round trips or held-out accuracy, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordovar.llm import ann, decontam, hmm, html_main, langid, neardup, packing, tokens, toxicity, warc
from ordovar.llm.common import crc_mod, scratch, table
from ordovar.llm.components import components
from ordovar.llm.queries import vocabulary_path

D = "/root/testdata/sf0.001"
LONG = "ab cd, " * 60_000
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "It's 12 o'clock <|endoftext|>  né\n\n日本 😀"), (5, LONG), (6, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"), (7, "!!!")]
DOCS = "doc_id long, text string, lang string, score double, n long"


@pytest.fixture(scope="module")
def awkward(spark):
    """With nulls, repeated rows, an empty and a long text, and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, 0.5, 9) for i, t in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def exact_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_language(spark, awkward, empty):
    docs = table(spark, D, "documents")
    profiles = langid.train(docs, crc_mod("doc_id", 3) != 1)
    got = langid.predict(docs, profiles).where(crc_mod("doc_id", 3) == 1).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95
    said = {r["doc_id"]: r for r in langid.predict(awkward, profiles).collect()}
    assert len(langid.predict(awkward, profiles).collect()) == len(AWKWARD)
    assert all(said[i]["lang_pred"] == "und" for i in (1, 2, 3, 7)) and all(0 <= r["score"] <= 1 for r in said.values())
    assert langid.train(empty, F.lit(True)) == [] and langid.predict(awkward, []).where("lang_pred <> 'und'").isEmpty()
    assert langid.predict(empty, profiles).isEmpty()


def test_near_duplicates(spark, awkward, empty):
    rng = random.Random(3)
    line = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(line + [f"p{rng.randrange(12)}" for _ in range(rng.randrange(0, 12))])) for i in range(60)]
    base = [f"b{i}" for i in range(60)]
    for i in range(60, 110):  # copies of one text with a changed word each
        own = list(base)
        own[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_components(rows)
    odd = neardup.near_duplicates(awkward).collect()
    assert len(odd) == len(AWKWARD)
    assert {r["n_shingles"] for r in odd if r["doc_id"] in (1, 2, 3)} == {0} and all(r["kept"] for r in odd)
    assert neardup.near_duplicates(empty).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (100, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_html(spark):
    rng = np.random.default_rng(1234)
    pages = [html_main.made_page(rng) for _ in range(150)]
    right = 0
    for page, text in zip(pages, html_main.main_texts(pages, html_main.trained()), strict=True):
        _, runs = html_main.parse(page)
        right += text == " ".join(t for _, t in runs if t.startswith("x"))
    assert right > 0.8 * len(pages)
    odd = ["<nav><a href=/>home</a></nav><article><h1>A title</h1><p>1 &lt; 2 &amp; 3 < 4 <b>bo</b>ld<script>x<y</script>&nbsp; end<p>more words here.</article>", "<p>", "", None, "<a href='x>y'", "<!-- never closed"]
    df = spark.createDataFrame([(i, h, "t") for i, h in enumerate(odd)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(df).collect()}
    assert got[0] == "A title 1 < 2 & 3 < 4 bold end more words here." and got[1] == got[2] == got[3] == got[5] == ""


def test_token_counts(spark, awkward, empty):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(vocabulary_path())
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(awkward, vocabulary_path()).collect()))
    assert got == sorted((i or 0, len((t or "").encode()), len(real.encode(t or "", add_special_tokens=False))) for i, t in AWKWARD)
    assert tokens.count_tokens(empty, vocabulary_path()).isEmpty()


def test_token_ids_of_random_texts():
    from tokenizers import Tokenizer

    from ordovar.llm.bpe_transducer import transducer

    real, machine, rng = Tokenizer.from_file(vocabulary_path()), transducer(vocabulary_path()), random.Random(5)
    texts = ["".join(rng.choice("abst'relvdm  \n\t!?.-1920éß<|>日 ") for _ in range(rng.randrange(80))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    ids, first = machine.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, e in enumerate(real.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids


def test_nearest_neighbours(spark):
    e = table(spark, D, "embeddings")
    odd = spark.createDataFrame([(1001, None), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] * 64), (1005, []), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    both = e.select("vec_id", "embedding").unionByName(odd)
    got = ann.search(both, both.where("vec_id % 20 = 0"), block_vectors=100, block_queries=7).collect()
    rows = e.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        hit += len(want & {r["vec_id"] for r in got if r["query_id"] == ids[q]})
        total += 20
    assert hit >= 0.9 * total and len(got) == total
    few = e.limit(3).select("vec_id", "embedding")
    assert ann.search(few, few).count() == 6


def test_nearest_neighbours_verify_few():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12_000, 48)) * rng.uniform(0.8, 1.2, (12_000, 1))
    lines, hit, verified = ann.Lines(x, 20), 0, 0
    for i in range(0, 12_000, 200):
        skip = np.arange(12_000) == i
        places, score, seen = lines.nearest(x[i], 20, skip)
        verified += seen
        s = np.where(skip, -np.inf, x @ x[i])
        hit += len(set(places[np.argsort(-score)][:20]) & set(np.argsort(-s)[:20]))
    assert hit >= 0.9 * 60 * 20 and verified <= 0.1 * 60 * 12_000


def test_nearest_neighbours_ties_repeats_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    far = rng.standard_normal((300, 6)).tolist()
    rows = [(i, v, "x", 1.0, 7) for i, v in enumerate(far, 1000)]
    rows += [(i, [9.0] * 6, "x", 1.0, 7) for i in (40, 7, 90, 7, 3, 60)]  # equal vectors, one row twice
    rows += [(20, [9.0] * 6, "x", 1.0, 7), (21, [1.0, 2.0], "x", 1.0, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, score double, rank int")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id = 20"), k=4, block_vectors=100).collect())
    assert got == [(1, 3), (2, 7), (3, 7), (4, 40)]
    assert ann.search(df, df.where("vec_id = 21"), k=4).isEmpty()
    none = df.limit(0)
    assert ann.search(df, none).isEmpty() and ann.search(none, df).isEmpty() and ann.search(none, none).isEmpty()
    with pytest.raises(ValueError):
        ann.search(df, df, block_vectors=70_000)


def check_base(got, rows, trains, ids=None):
    """n_tokens, n_known, train_tokens and base_score by the contract's formula."""
    count = Counter()
    for i in ids or rows:
        if trains(i):
            count.update(words(rows[i]))
            count[None] += 1
    total, distinct = sum(count.values()), len(count)
    for r in got:
        own = [*words(rows[r["doc_id"]]), None]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(count[w] > 0 for w in own), total, not trains(r["doc_id"]))
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0


def test_language_model(spark, awkward, empty):
    docs = table(spark, D, "documents")
    got = hmm.score(docs, crc_mod("doc_id", 7) != 2).collect()
    assert sum(r["score"] > r["base_score"] for r in got if r["held_out"]) > 0.8 * sum(r["held_out"] for r in got)
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check_base(got, rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    odd = hmm.score(awkward.where("doc_id is not null"), F.lit(True)).collect()
    check_base(odd, dict(AWKWARD), lambda i: True, [i for i, _ in AWKWARD if i])
    assert len({r["score"] for r in odd if r["doc_id"] == 6}) == 1 and len({r["score"] for r in odd if r["doc_id"] in (1, 2, 3)}) == 1
    assert len(hmm.score(awkward, F.lit(True)).collect()) == len(AWKWARD)
    assert hmm.score(awkward, F.lit(False)).where("n_known > 0").isEmpty() and hmm.score(empty, F.lit(True)).isEmpty()


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    lens = [1, 4, 1024, 1025, 3000]
    first = np.cumsum([0, *lens])
    cls = rng.integers(0, 5, first[-1]).astype(np.uint16)
    for k, got in enumerate(hmm.forward(cls, first, model)):
        a, total = model.start, 0.0
        for t, c in enumerate(cls[first[k] : first[k + 1]]):
            a = (a if t == 0 else a @ model.move) * model.emit[c]
            total += np.log10(a.sum())
            a = a / a.sum()
        assert abs(got - total) < 1e-8 * max(1, abs(total))


def test_long_texts_count_as_whole():
    rng = np.random.default_rng(12)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T)
    lens = [3000, 1, 64, 65, 700, 128]
    first = np.cumsum([0, *lens])
    cls = rng.integers(0, 7, first[-1]).astype(np.uint16)
    whole, cut = hmm.expected(cls, first, model, 10_000), hmm.expected(cls, first, model, 64)
    for a, b in zip(whole, cut, strict=True):
        assert np.allclose(a, b, rtol=1e-9)
    assert abs(cut[0].sum() - len(lens)) < 1e-9 and abs(cut[1].sum() - (first[-1] - len(lens))) < 1e-6
    assert np.allclose(hmm.forward(cls, first, model, 64), hmm.forward(cls, first, model, 10_000), rtol=1e-10)
    assert abs(hmm.forward(cls, first, model).sum() - cut[3]) < 1e-6


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    first = np.arange(0, 2001, 50)
    cls = np.where(np.arange(2000) // 10 % 2, rng.integers(0, 3, 2000), rng.integers(3, 6, 2000)).astype(np.uint16)
    model, before = hmm.first_guess(np.full(6, 1 / 6), 2), -np.inf
    for _ in range(5):
        s, m, e, ll = hmm.expected(cls, first, model)
        assert ll >= before - 1e-9 and abs(e.sum() - 2000) < 1e-6
        before, model = ll, hmm.Hmm(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


def test_warc(spark):
    rows = [(1, "http://a/ b\r\nX", "x" * 50_000), (2, None, None), (3, "u", "x" * 50_000), (4, "u", "short"), (5, "u", "short"), (None, "u", "x" * 50_000), (6, "u", "é日" * 9000), (6, "u", "é日" * 9000)]
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.reassembled(warc.read_archives(spark, path)).collect()
    key = lambda x: (x[0] or 0, x[1], x[2] or 0, x[3] or b"")
    want = [(i, "revisit" if i == 3 else "response", 1 if i == 3 else None, None if i == 3 else (h or "").encode()) for i, _, h in rows]
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert all(r["problem"] is None for r in got) and {r["digest"] for r in got if r["page_id"] == 3} == {hashlib.sha256(b"x" * 50_000).hexdigest()}
    lacking = warc.reassembled(warc.read_archives(spark, path).where("number is null or number <> 2")).where("problem is not null")
    assert lacking.count() == 4
    assert warc.resolved(warc.reassembled(warc.read_archives(spark, path))).where("problem is not null").isEmpty()
    alone = warc.read_archives(spark, path).where("type = 'revisit'")
    assert [r["problem"] for r in warc.resolved(warc.reassembled(alone)).collect()] == ["the response it names is missing"]


def test_warc_empty_and_clashing_columns(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.reassembled(warc.read_archives(spark, path))).isEmpty()
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "x" * 300, "d", 3, 4), (2, "u", "x" * 300, "d", 3, 4)], "page_id long, url string, html string, digest string, first long, c long"), path)
    got = warc.resolved(warc.reassembled(warc.read_archives(spark, path))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_length"], r["problem"]) for r in got) == [(1, "response", None, 300, None), (2, "revisit", 1, 300, None)]


def test_warc_foreign_and_damaged_files(spark, tmp_path):
    """One member a record, plain files, no framing, no digest; and files that are damaged beside them."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    make = lambda name, body, kind="response": warc.record(kind, f"<urn:x:{name}>", [], body) + b"\r\n"
    pages = [make(i, http + b"page %d" % i) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in [make("info", b"software: x", "warcinfo"), *pages[:3]]))
    (tmp_path / "b.warc").write_bytes(pages[3] + pages[4])
    payloads = lambda: sorted((bytes(r["payload"]) if r["payload"] is not None else b"", r["problem"]) for r in warc.reassembled(warc.read_archives(spark, str(tmp_path))).collect())
    assert payloads() == [(b"page %d" % i, None) for i in range(5)]
    whole = b"".join(gzip.compress(make(i, http + b"page %d" % i)) for i in (5, 6))
    (tmp_path / "c.warc.gz").write_bytes(whole[:-20])
    (tmp_path / "d.warc").write_bytes(make(7, http + b"page 7").replace(b"Content-Length: ", b"Content-Length: 9") + b"noise" + make(8, http + b"page 8") + b"WARC/1.1\r\nWARC-Type: response")
    (tmp_path / "e.warc").write_bytes(make(9, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nno\r\n0\r\n\r\n"))
    got = payloads()
    assert [p for p, problem in got if problem is None] == [b"page %d" % i for i in (0, 1, 2, 3, 4, 5, 8)]
    said = [problem for _, problem in got if problem is not None]
    assert sum("length" in p for p in said) == 3 and "a chunk has no size" in said and any("gzip" in p for p in said)


def test_packing(spark, awkward, empty):
    for cap, df in ((64, awkward), (2048, table(spark, D, "documents").select("doc_id", "text"))):
        got = packing.pack(df, vocabulary_path(), cap).toPandas().sort_values(["sequence_id", "offset"])
        by = got.groupby("sequence_id").length
        assert (by.sum() <= cap).all() and (got.offset == by.cumsum() - got.length).all()
        assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // cap) + 1
    assert packing.pack(empty, vocabulary_path()).isEmpty()


def test_packing_pieces_are_the_tokenizers(spark, awkward):
    """Every column against the library's ids: pieces, starts, lengths, checksums, places; and that rows are packed each."""
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(vocabulary_path())
    for cap, rows in ((64, AWKWARD), (2048, AWKWARD + [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()])):
        df = spark.createDataFrame([(i, t, 7, 7) for i, t in rows], "doc_id long, text string, piece int, length long")
        got = packing.pack(df, vocabulary_path(), cap).collect()
        want = Counter()
        for i, t in rows:
            ids = np.array([*real.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            cuts = [0, *range((len(ids) - 1) % cap + 1, len(ids) + 1, cap)]
            want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        places = {}
        for r in got:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= cap


def test_packing_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    hist = np.zeros(257, np.int64)
    hist[1:] = rng.integers(0, 50, 256)
    made = packing.plan(hist, 256)
    for n in range(1, 257):
        assert hist[n] == 0 or 0 in made["rank"][made["length"] == n]
    assert made["sequences"][0] <= 1.02 * max(-(-(hist * np.arange(257)).sum() // 256), hist[129:].sum())


def test_toxicity(spark, awkward, empty):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs.where(crc_mod("doc_id", 5) != 0), labels)
    got = toxicity.score(docs.where(crc_mod("doc_id", 5) == 0), model).join(labels, "doc_id").select("score", "toxic").collect()
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in got) > 0.95 * len(got)
    assert len(toxicity.score(awkward, model).collect()) == len(AWKWARD)
    none = toxicity.fit(empty, labels)
    assert toxicity.score(awkward, none).where("score > 0").isEmpty()


def test_toxic_terms_survive_copies_of_one_text(spark):
    """Neither a bound on the vocabulary nor many near copies of one labelled text keep out the terms that mark label 1."""
    rng = random.Random(6)
    name = lambda n: "".join(chr(97 + n // 26**j % 26) for j in range(3))
    insults, plain, own = (["".join((p, name(n))) for n in range(size)] for p, size in (("i", 600), ("p", 400), ("o", 550)))
    rows = [(" ".join(rng.sample(plain, 60)), 0) for _ in range(200)]
    rows += [(" ".join(rng.sample(plain, 40) + rng.sample(insults, 200)), 1) for _ in range(80)]
    rows += [(" ".join([*own, f"x{name(n)}"]), 1) for n in range(150)] + [(" ".join(own), 1)] * 50
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(insults) <= set(model.number) and not set(own) & set(model.number)
    assert model.score(" ".join(plain[:50] + insults[:3]))[0] > 0.5 and model.score(" ".join(plain[:50] + own[:20]))[0] < 0.5


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(8)
    vecs = []
    for _ in range(300):
        t = np.sort(rng.choice(20, rng.integers(1, 6), replace=False))
        w = rng.random(len(t))
        vecs.append((t, w / np.sqrt(w @ w)))
    index = toxicity.Index.build(np.arange(300), np.zeros(300), vecs, 20)
    dense = np.zeros((300, 20))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    for i in range(0, 300, 7):
        s = dense @ dense[i]
        s[i] = 0
        docs, cos = index.nearest(*vecs[i], 9, leave=i)
        assert np.allclose(cos, np.sort(s)[::-1][: len(cos)])


def test_decontamination(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "One two THREE four five"), (2, "a b c d e f g h i j k l"), (3, None), (4, "..."), (None, "one two three four five")], "item_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(10, "x a b c d e f g h i j y b c d e f g h i j k"), (11, "a b c d e f g h i")], "doc_id long, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontam.report(docs, bench).collect()]
    assert (10, 22, 20, [2]) in got and (11, 9, 0, []) in got and got.count((6, 6, 5, [1])) == 2 and (None, 6, 5, [1]) in got and (1, 0, 0, []) in got
    assert len(got) == len(AWKWARD) + 2
    assert decontam.hits(docs, bench, broadcast_limit=0).count() == decontam.hits(docs, bench).count()
    assert decontam.report(decontam.drop_spans(docs, bench), bench).where("n_hit > 0").isEmpty()
    assert decontam.drop_documents(docs, bench).count() == len(docs.collect()) - 4
    assert decontam.report(empty, bench).isEmpty() and decontam.report(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = table(spark, D, "documents")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, kept, D).persist()
        assert kept.columns == docs.columns, name
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    sizes = exact_components(list(left.items()))
    assert all(c == i for i, (_, c) in sizes.items())
    assert len(left) > 0.8 * docs.count()
    packed = c.run(spark, D)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)


def test_pipeline_dedup_keeps_null_and_repeated_ids(spark, awkward, empty):
    import corpus_pipeline as c

    text = lambda p: " ".join(f"{p}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("d") + " e"), (5, None), (5, ""), (None, text("f")), (None, text("g")), (None, text("g")), (None, None)]
    kept = c.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    gone = [(2, text("a")), (2, text("b")), (4, text("d") + " e")]
    want = list(rows)
    for r in gone:  # a copy of 1's, one of two equal rows, a near copy of 3's
        want.remove(r)
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))
    assert c.dedup(spark, awkward, D).count() == len(AWKWARD) - 1 and c.dedup(spark, empty, D).isEmpty()
