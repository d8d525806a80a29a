"""Tensor-ready export of sequence windows: fixed length, numeric matrix, masked second view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventstrand.functions.sequences import feature_matrix, mask_sequence, pad_right


def pad_windows(windows: DataFrame, length: int, with_balance: bool = True) -> DataFrame:
    """Right-pad all lists with 0 to ``length`` and turn the feature structs into a matrix."""
    width = 3 if with_balance else 2
    zero_row = F.array(*[F.lit(0.0).cast("float")] * width)
    byte_zero = F.lit(0).cast("tinyint")
    return windows.withColumns(
        {
            "input_event_seq": pad_right(F.col("input_event_seq"), length, byte_zero),
            "input_product_seq": pad_right(
                F.col("input_product_seq"), length, F.lit(0).cast("bigint")
            ),
            "num_feats_seq": pad_right(
                feature_matrix(F.col("num_feats_seq"), with_balance), length, zero_row
            ),
            "target_event_seq": pad_right(F.col("target_event_seq"), length, byte_zero),
        }
    )


def mask_events(windows: DataFrame, probability: float = 0.15, seed: int = 0) -> DataFrame:
    """Add the second view ``input_event_seq_v2``: the same events, some set to 0."""
    masked = mask_sequence(
        F.col("input_event_seq"), probability, seed, F.col("user_id"), F.col("window_start")
    )
    return windows.withColumn("input_event_seq_v2", masked)
