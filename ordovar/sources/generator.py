"""The seeded generator, in parallel: each lane jumps to its first element.

Its three parts jump on their own: the linear congruence by an affine power, the shift register by a power of its matrix over GF(2),
the multiply-with-carry as a power of its multiplier modulo a * 2^32 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generator.
LCG_A, LCG_C, MWC_A = 314527869, 1234567, 4294584393
SHIFTS = (5, 7, 22)
WORD = (1 << 32) - 1


def seeded(seed: int) -> tuple[int, int, int, int]:
    x = seed & WORD
    y = (69069 * x + 12345) & WORD
    z = ((y << 16) + x) & WORD
    return x, y, z, z << 13 & WORD


def _shift_register(y: int) -> int:
    y ^= y << SHIFTS[0] & WORD
    y ^= y >> SHIFTS[1]
    return y ^ (y << SHIFTS[2] & WORD)


def _apply(matrix: list[int], y: int) -> int:
    out = 0
    for bit in range(32):
        if y >> bit & 1:
            out ^= matrix[bit]
    return out


def jumped(state: tuple[int, int, int, int], steps: int) -> tuple[int, int, int, int]:
    """The state after so many elements, in log2(steps) work."""
    x, y, z, c = state
    a, b, pa_, pb = 1, 0, LCG_A, LCG_C
    power = [_shift_register(1 << i) for i in range(32)]
    k = steps
    while k:
        if k & 1:
            a, b = a * pa_ & WORD, (b * pa_ + pb) & WORD
            y = _apply(power, y)
        pa_, pb = pa_ * pa_ & WORD, (pb * pa_ + pb) & WORD
        power = [_apply(power, power[i]) for i in range(32)]
        k >>= 1
    x = (a * x + b) & WORD
    if steps:  # one plain step brings the carry into range, the others are a power
        t = MWC_A * z + c
        t = t * pow(MWC_A, steps - 1, MWC_A * (1 << 32) - 1) % (MWC_A * (1 << 32) - 1) if steps > 1 else t
        z, c = t & WORD, t >> 32
    return x, y, z, c


def elements(seed: int, first: int, count: int, lanes: int = 1024) -> np.ndarray:
    """Elements first .. first + count - 1."""
    lanes = max(1, min(lanes, count))
    each = -(-count // lanes) if count else 0
    states = [jumped(seeded(seed), first)]
    for _ in range(lanes - 1):
        states.append(jumped(states[-1], each))
    x, y, z, c = (np.array([s[i] for s in states], np.uint64) for i in range(4))
    out = np.empty((lanes, each), np.int32)
    word = np.uint64(WORD)
    for k in range(each):
        x = (x * np.uint64(LCG_A) + np.uint64(LCG_C)) & word
        y ^= y << np.uint64(SHIFTS[0]) & word
        y ^= y >> np.uint64(SHIFTS[1])
        y ^= y << np.uint64(SHIFTS[2]) & word
        t = np.uint64(MWC_A) * z + c
        z, c = t & word, t >> np.uint64(32)
        out[:, k] = np.abs(((x + y + z) & word).astype(np.uint32).view(np.int32))
    return out.ravel()[:count]


def generate(spark: SparkSession, m: int, seed: int, parts: int | None = None, modulus: int | None = None) -> DataFrame:
    """(pos, value) of the data set (m, seed); modulus 100 gives the one with many duplicates."""
    parts = parts or max(1, min(spark.sparkContext.defaultParallelism, m // 100_000 + 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("id").to_pylist():
                lo, hi = m * p // parts, m * (p + 1) // parts
                for at in range(lo, hi, 1 << 20):
                    n = min(1 << 20, hi - at)
                    v = elements(seed, at, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array(v if modulus is None else v % modulus)], ["pos", "value"])

    return spark.range(0, parts, 1, parts).mapInArrow(kernel, "pos long, value int")


def table_name(m: int, seed: int, algo: str | None = None) -> str:
    return f"M{m}_s{seed}." + (f"{algo}.sorted" if algo else "unsorted")


def cached(spark: SparkSession, folder: str, m: int, seed: int) -> DataFrame:
    """The data set (m, seed), generated once; a table with another row count is an error."""
    path = f"{folder}/{table_name(m, seed)}"
    generate(spark, m, seed).write.mode("ignore").parquet(path)
    df = spark.read.parquet(path)
    if df.count() != m:
        raise ValueError(f"{path} does not have {m} rows")
    return df.withColumn("value", F.col("value").cast("int"))
