"""Validation losses over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventstrand.functions.sequences import PADDING
from eventstrand.functions.vectors import log_sum_exp
from eventstrand.operators.ranking import seeded_batches

# Fixed values of the loss functions.
FOCAL_GAMMA = 2.5
TEMPERATURE = 0.07
# Classes are event codes; this bounds the broadcast class table.
MAX_CLASSES = 10_000
# A batch is one square matrix in a task: 8 bytes times its square, 512 MB at most.
MAX_BATCH = 8_192


def _by_class(weights: DataFrame) -> DataFrame:
    """(target, __weight), one row per class from 0 to ``MAX_CLASSES``; two weights of a class are an error."""
    twice = F.raise_error(F.concat(F.lit("two weights for class "), F.col("target").cast("string")))
    return (
        weights.where(F.col("event_type").between(0, MAX_CLASSES))
        .groupBy(F.col("event_type").cast("int").alias("target"))
        .agg(F.count(F.lit(1)).alias("__n"), F.max("weight").alias("__weight"))
        .select("target", F.when(F.col("__n") > 1, twice).otherwise(F.col("__weight")).alias("__weight"))
    )


def mean_loss(total: Column, n_rows: Column) -> Column:
    """Sum over count; 0 without rows."""
    return F.coalesce(F.try_divide(total, n_rows), F.lit(0.0))


def _with_focal(scored: DataFrame, weights: DataFrame, gamma: float, target_score: Column, log_sum: Column) -> DataFrame:
    """Add ``focal`` from the score of the target (null if the target is not a class) and the log-sum-exp of all scores.

    Padded targets contribute 0.  A row without target, a target outside the scores and a class without
    weight are errors, so no row can drop out of a mean.
    """
    target = F.col("target")
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} "), F.coalesce(target.cast("string"), F.lit("null"))))
    ce = F.col("__weight") * (log_sum - target_score)
    loss = F.pow(1 - F.exp(-F.col("__ce")), F.lit(gamma)) * F.col("__ce")
    checked = (
        F.when(target.isNull() | target_score.isNull(), wrong("target outside the logits:"))
        .when(target == PADDING, F.lit(0.0))
        .when(F.col("__ce").isNull(), wrong("no weight for class"))
        .otherwise(loss)
    )
    return (
        scored.join(F.broadcast(_by_class(weights)), "target", "left")
        .withColumn("__ce", ce).withColumn("focal", checked).drop("__ce", "__weight")
    )


def focal_rows(scored: DataFrame, weights: DataFrame, gamma: float = FOCAL_GAMMA) -> DataFrame:
    """Add ``focal`` to rows of (logits, target): weighted cross entropy scaled by (1 - p) ** gamma."""
    target = F.col("target")
    inside = (target >= 0) & (target < F.size("logits"))
    own = F.when(inside, F.get("logits", target).cast("double"))
    return _with_focal(scored, weights, gamma, own, log_sum_exp(F.col("logits")))


def focal_positions(positions: DataFrame, weights: DataFrame, gamma: float = FOCAL_GAMMA) -> DataFrame:
    """The same for rows of (target, target_score, log_sum), as :func:`score_positions` reduces them."""
    return _with_focal(positions, weights, gamma, F.col("target_score"), F.col("log_sum"))


def focal_loss(scored: DataFrame, weights: DataFrame, gamma: float = FOCAL_GAMMA) -> DataFrame:
    """Mean over all rows; padded ones stay in the denominator."""
    n_rows = F.count(F.lit(1))
    return focal_rows(scored, weights, gamma).agg(
        mean_loss(F.sum("focal"), n_rows).alias("focal_loss"), n_rows.alias("n_rows")
    )


def batch_info_nce(
    pairs: DataFrame, view1: str, view2: str, temperature: float = TEMPERATURE
) -> DataFrame:
    """Contrastive loss per ``batch_id``; batches come from :func:`seeded_batches`, so they are small.

    A batch is one matrix product inside a task; no pair of rows is ever written out.
    """

    def loss(batch: pd.DataFrame) -> pd.DataFrame:
        def unit_rows(column):
            matrix = np.stack(batch[column].to_numpy()).astype("float64")
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            return matrix / np.maximum(norms, 1e-12)

        similarity = unit_rows(view1) @ unit_rows(view2).T / temperature
        top = similarity.max(axis=1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(similarity - top).sum(axis=1))
        return pd.DataFrame(
            {
                "batch_id": [batch["batch_id"].iloc[0]],
                "n_rows": [len(batch)],
                "loss": [float((lse - similarity.diagonal()).mean())],
            }
        )

    return (
        pairs.select("batch_id", view1, view2)
        .groupBy("batch_id")
        .applyInPandas(loss, "batch_id bigint, n_rows bigint, loss double")
    )


def info_nce(
    pairs: DataFrame,
    key: Sequence[str],
    view1: str,
    view2: str,
    batch_size: int = 512,
    temperature: float = TEMPERATURE,
    seed: int = 0,
) -> DataFrame:
    """Mean of the batch losses over seeded random batches; 0 without any batch."""
    if not 0 < batch_size <= MAX_BATCH:
        raise ValueError(f"batch_size must be from 1 to {MAX_BATCH}")
    batches = seeded_batches(pairs.select(*key, view1, view2), key, batch_size, seed)
    return batch_info_nce(batches, view1, view2, temperature).agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("info_nce"), F.count(F.lit(1)).alias("n_batches")
    )
