"""Token counts by finite-state transducer (see bpe_transducer).

Nulls and empty texts have no bytes and no tokens. Repeated rows are counted each. Only the two named columns are read, so further
columns of any name do no harm. A text of any length is counted whole: its chunks are bounded, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordovar.llm.bpe_transducer import transducer
from ordovar.llm.common import lean, small_batches, text_slices

TOKEN_LIMIT = 512


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row. vocabulary: path of a byte-level BPE file, readable on every executor."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offsets in text_slices(batch, "text"):
                sizes.append(np.diff(offsets))
                counts.append(machine.counts(buf, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts))], ["id", "n_bytes", "n_tokens"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(kernel), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def with_limit(counts: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
