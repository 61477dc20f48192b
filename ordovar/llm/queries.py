"""The queries opN_<name> over whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordovar.llm import ann, decontam, hmm, html_main, langid, neardup, packing, tokens, toxicity, warc
from ordovar.llm.common import crc_mod, scratch, table, written


def vocabulary_path() -> str:
    """The byte-level BPE file; ORDOVAR_VOCABULARY overrides where the installed tokenizer package has it."""
    if found := os.environ.get("ORDOVAR_VOCABULARY"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.train(docs, crc_mod("doc_id", 3) != 1)
    rows = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return langid.predict(rows, profiles, keep=("doc_id", "held_out"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_limit(tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path()))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)


def op7_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.resolved(written(spark, warc.reassembled(warc.read_archives(spark, path), payloads=False), "records"))
    return records.select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "problem")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(crc_mod("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_near_duplicates, op3_html_main_text, op4_token_counts, op5_nearest_neighbours, op6_lm_scores, op7_warc_records, op8_packing, op9_toxicity, op10_decontamination)
}

_WORDS10 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select doc_id, case when ws is null or len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh from w),
e as (select doc_id, unnest(sh) g from s),
df as (select g from e group by g having count(*) > 1),
p as (
  select a.doc_id a, b.doc_id b, count(*) n from e a join df using (g) join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
d as (select a, b from l union select b, a from l),
r as (select doc_id a, doc_id b from s union select r.a, d.b from r join d on r.b = d.a)
select s.doc_id, len(s.sh)::bigint n_shingles, min(r.b) component_id, s.doc_id = min(r.b) kept from s join r on r.a = s.doc_id group by s.doc_id, s.sh""",
    "op5_nearest_neighbours": r"""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op7_warc_records": r"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h))::bigint n, sha256(h) x from p),
f as (select x, min(page_id) m from d where n >= 100 group by x)
select page_id, n payload_bytes, d.x payload_digest, case when m < page_id then 'revisit' else 'response' end record_type,
  case when m < page_id then m end refers_to, null::varchar problem from d left join f on f.x = d.x""",
    "op10_decontamination": rf"""
with b as (select item_id, {_WORDS10} ws from benchmark where text is not null),
bw as (select item_id, unnest(case when len(ws) = 0 then [] when len(ws) <= 10 then [ws] else list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) end) win from b),
k as (select distinct item_id, array_to_string(win, ' ') win, len(win) n from bw),
ns as (select distinct n from k),
d as (select doc_id, coalesce({_WORDS10}, []) ws from documents),
dw as (select doc_id, n, unnest(case when len(ws) < n then [] else range(1, len(ws) - n + 2) end) i, ws from d, ns),
h as (select doc_id, i, dw.n, item_id from dw join k on k.n = dw.n and k.win = array_to_string(ws[i:i + dw.n - 1], ' ')),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by 1),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) names from h group by 1)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""",
}
