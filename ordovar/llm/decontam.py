"""Benchmark decontamination with DataFrame functions alone.

A window is `size` consecutive words of an item, or the whole item if it is shorter. Each distinct window is looked up by its anchor,
its longest word; the words of the documents probe the broadcast hash set of anchors, and a probe that finds one is verified by
comparing the whole window. The windows are broadcast only if at most BROADCAST_WINDOWS of them exist; beyond, documents' windows are
joined with them by shuffle, with the same result.

Null texts have no words and no hits; items without words have no window; null item ids are not listed. Rows that share id and text
get the same result each. Equal windows of several items count for all of them. Further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: About 300 bytes each.
BROADCAST_WINDOWS = 200_000
#: What separates words: all of ASCII but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), f"{GAP}+"), "")


def windows(bench: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n, anchor, shift, items): distinct windows, their anchor word and its place, the items that hold them."""
    rows = bench.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    each = rows.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size)), lambda i: F.slice("w", i + 1, F.lit(size)))).alias("window"))
    distinct = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("window", lambda w, i: F.struct(F.length(w).alias("len"), (-i).alias("back"), w.alias("word"))))
    return distinct.withColumn("__a", longest).select("window", F.size("window").alias("n"), F.col("__a.word").alias("anchor"), (-F.col("__a.back")).alias("shift"), "items")


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), F.length(text_col).alias("__len")]


def hits(df: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """(__id, __h, __len, spans, items) of each text with a window in it: merged half-open spans of word places, and the items found."""
    wins = windows(bench, size)
    docs = df.where(F.col(text_col).isNotNull()).select(*_key(id_col, text_col), words(F.col(text_col)).alias("w"))
    if wins.count() <= broadcast_limit:
        probes = docs.select("*", F.posexplode("w").alias("at", "word"))
        start = F.col("at") - F.col("shift")
        found = probes.join(F.broadcast(wins), F.col("word") == F.col("anchor")).where((start >= 0) & (start + F.col("n") <= F.size("w")))
        found = found.where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window")).select("__id", "__h", "__len", start.alias("start"), "n", "items")
    else:
        lengths = [r["n"] for r in wins.select("n").distinct().collect()]  # at most `size` numbers

        def of_length(n: int) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n)), lambda i: F.struct(i.alias("start"), F.slice("w", i + 1, F.lit(n)).alias("window")))
            return F.when(F.size("w") >= n, runs).otherwise(F.array().cast("array<struct<start:int,window:array<string>>>"))

        every = F.flatten(F.array(*map(of_length, lengths)))
        found = docs.select("__id", "__h", "__len", F.explode(every).alias("x")).select("__id", "__h", "__len", "x.start", "x.window").join(wins, "window").select("__id", "__h", "__len", "start", "n", "items")
    got = found.groupBy("__id", "__h", "__len").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("raw"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    return got.withColumn("raw", F.col("raw").cast("array<struct<start:int,stop:int>>")).select("__id", "__h", "__len", F.expr("""
        aggregate(raw, cast(array() as array<struct<start:int,stop:int>>), (done, x) ->
            case when size(done) > 0 and element_at(done, -1).stop >= x.start
                 then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, x.stop))))
                 else concat(done, array(x)) end)""").alias("spans"), "items")  # fmt: skip


def _joined(df: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str = "left") -> DataFrame:
    left = df.withColumn("__k", F.struct(*_key(id_col, text_col)))
    cond = F.col("__k.__id").eqNullSafe(found["__id"]) & (F.col("__k.__h") == found["__h"]) & (F.col("__k.__len") == found["__len"])
    return left.join(found, cond, how)


def report(df: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every row."""
    found = hits(df, bench, size, id_col, text_col)
    narrow = df.select(F.col(id_col), *_key(id_col, text_col), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    l, r = narrow.alias("l"), found.alias("r")
    cond = F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__h") == F.col("r.__h")) & (F.col("l.__len") == F.col("r.__len"))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]), F.lit(0)).cast("long")
    return l.join(r, cond, "left").select(F.col(f"l.{id_col}").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"), "spans")


def drop_documents(df: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows in which a window of the benchmark occurs."""
    return _joined(df, hits(df, bench, size, id_col, text_col).select("__id", "__h", "__len"), id_col, text_col, "left_anti").drop("__k")


def drop_spans(df: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the hit words, and the gaps before them, taken out of the texts."""
    found = hits(df, bench, size, id_col, text_col).select("__id", "__h", "__len", "spans")
    parts = F.regexp_extract_all(F.col(text_col), F.lit(rf"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    kept = F.filter(parts, lambda x, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["stop"])))
    tail = F.regexp_extract(F.col(text_col), rf"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)
    clean = F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return _joined(df, found, id_col, text_col).withColumn(text_col, clean).drop("__k", "__id", "__h", "__len", "spans")
