"""From documents to packed training sequences. Each stage works on all that the one before kept; each result is a Parquet table.

Rejected: by language ID, documents without a letter or whose n-grams lie in no profile; by toxicity, documents predicted toxic; by
near-dedup, all but the smallest id of each group (null ids are in none); by decontamination, documents in which a benchmark window occurs.

Documents with a null id pass or fail each stage by their text like others, and never train. Null and empty texts hold no letter and go in
the first stage. Empty tables give no pieces. Rows that repeat an id with its text are one document; rows that share only the id are judged
each. Further columns of documents pass through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordovar.llm import decontam, langid, neardup, packing, toxicity
from ordovar.llm.common import crc_mod, table, written
from ordovar.llm.queries import vocabulary_path

#: A text whose frequent n-grams lie in no profile. Measured: the least score of 113,000 documents of check_s, check_h, sf0.1 and sf0.01 is
#: 0.398 (0.1 % lie under 0.49); random letters score 0.16, base64 0.24, one letter repeated 0.25, random words 0.23.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.train(docs, crc_mod("doc_id", 3) != 1)
    said = langid.predict(docs, profiles)
    return said.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.where(crc_mod("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id. A document is an id with a text: rows that share both are one, rows
    that share only the id are judged each by its own text. Null ids link with nothing and stay, every row of them."""
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("__row", F.xxhash64("doc_id", "text"))
    near = neardup.near_duplicates(rows, id_col="__row", carry=["doc_id"])
    first = near.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.*")
    one = rows.join(first, ["__row", "doc_id"]).dropDuplicates(["__row", "doc_id"])
    return one.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [("language", language), ("toxicity", toxic), ("near_dedup", dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Language ID, nearest neighbours and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return written(spark, stage(spark, docs, sf_dir), name)
