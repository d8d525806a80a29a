"""Token counts: Arrow batches in, lengths out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventstrand.llm.tokens import by_bytes as _by_bytes, counter


def count_tokens(df: DataFrame, vocabulary: str, limit: int, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Whole texts are counted as the tokenizer counts them, without added special tokens.  Texts are cut at
    spaces between words, where its pieces end in any case, and only lengths leave the worker.  A null
    text counts as empty: 0 bytes, 0 tokens.  One row per input row, repeated ones included; all other
    columns stay, those with an output's name are replaced.  An empty table gives no rows.
    """

    @F.arrow_udf("long")
    def n_tokens(column: pa.Array) -> pa.Array:
        encode = counter(vocabulary).encode
        lengths = [n for part in _by_bytes(column) for n in encode(part.to_pylist())]
        return pa.array(lengths, type=pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": n_tokens(whole)}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
