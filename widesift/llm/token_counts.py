"""Token counts of whole texts: encoded in Arrow batches, only lengths are returned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from widesift.llm.tokens import Encoder, by_bytes


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key_col, n_bytes, n_tokens, over_limit) for every row.

    `tokenizer` is the path, on every executor, of a file with a byte-level BPE tokenizer without normaliser. Tokens are those
    that the library gives for the whole text, its special strings included, without added, truncated or padded ones. Null and
    empty texts have none. Repeated keys keep a row each; other columns are ignored, whatever their names. A text is cut at safe boundaries only, so its length bounds no step
    but the one over a stretch without any blank.
    """
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            counts = [np.diff(encode(part, lengths_only=True)[1]) for part in by_bytes(batch.column(1))]
            n = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["key", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
