"""Shared plumbing: tables, the shared folder, and byte-level batch access for the Arrow kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call works on; bounds the kernels' temporary arrays. A longer text is one call.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 2000


T = TypeVar("T")
_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], T]) -> T:
    """make()'s result, kept in this worker process for its later tasks. A worker holds one such object: what one operator compiled
    does not take room while another runs."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Returns to the system what this worker has freed; idle workers stay beside the next operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kernel, for mapInArrow, giving back memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to the kernels in batches of BATCH_ROWS rows, unless the session sets fewer: a batch lies in memory several times."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % m, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one, and a
    cluster an error, since its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ordovar-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: it survives lost executors and cuts the lineage."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return stored(spark, df, name)[0]


#: A key with more than one row in so many is hot; its rows are dealt to SALTS tasks.
HOT_SHARE = 1000
SALTS = 32


def joined_hot(rows: DataFrame, sums: DataFrame, key: str | list[str], total: int, spread: str, keep: bool = False) -> DataFrame:
    """rows joined with sums, which has one row a key, in `c` how many of the at most `total` rows the key has, and further columns.
    keep: rows that find none stay, with nulls. sums is read twice and should be stored.

    Keys of more than a thousandth of all rows, fewer than a thousand of them, become known to the driver; their rows are dealt to SALTS
    tasks by `spread`, and their sums to each of these. Neither side is bounded, so it is a merge join at every size. Of several key
    columns the first tells what is hot.
    """
    keys = [key] if isinstance(key, str) else key
    key = keys[0]
    names = [n for n in sums.columns if n not in (*keys, "c")]
    least = max(1, total // HOT_SHARE)
    hot = [r[key] for r in sums.where(F.col("c") > least).select(key).collect()]
    # without a hot key the salt is 0 in every row, but no constant, so that the plan is one at every size
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0) if hot else F.pmod(F.xxhash64(spread), F.lit(1))
    every = F.when(F.col("c") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spreadout = sums.select(*keys, *names, F.explode(every).alias("__salt"))
    return rows.withColumn("__salt", salt.cast("int")).join(spreadout.hint("merge"), [*keys, "__salt"], "left" if keep else "inner").drop("__salt").select(*rows.columns, *names)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of pieces of a text column; null texts are empty."""
    col = batch.column(column)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; 0 for empty segments."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: A-Z to a-z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: One random 64-bit value per byte and an odd multiplier, from a fixed seed.
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input bits (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse_powers(n: int) -> np.ndarray:
    inv = np.uint64(pow(int(_ODD), -1, 1 << 64))
    out = np.full(n, inv, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ in a byte buffer, and each row's first word (rows + 1 values)."""
    n = len(low)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    prev = np.empty(n, bool)
    if n:
        prev[0] = False
        prev[1:] = word[:-1]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    starts = np.flatnonzero(word & (~prev | first))
    last = np.ones(n, bool)
    last[:-1] = ~word[1:] | first[1:]
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes in every batch."""
    n = len(low)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * _powers(n), dtype=np.uint64)])
    raw = (acc[ends] - acc[starts]) * _inverse_powers(n)[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix64(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
