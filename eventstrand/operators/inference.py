"""Batch scoring of padded windows with any user-supplied model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType

from eventstrand.functions.sequences import rows_of


def _scorer(make_predict_fn: Callable, element: DataType, shapes: list[list[int]], batch_size: int) -> Callable:
    """Declared nondeterministic: otherwise a later filter or explode would run the model a second time."""
    return predict_batch_udf(
        make_predict_fn, return_type=ArrayType(element), batch_size=batch_size, input_tensor_shapes=shapes
    ).asNondeterministic()


def _inputs(events: str = "input_event_seq") -> list[Column]:
    return [F.col(events), F.col("input_product_seq"), F.flatten("num_feats_seq")]


def score_windows(
    padded: DataFrame,
    make_predict_fn: Callable,
    output: str,
    length: int,
    n_feats: int = 3,
    batch_size: int = 256,
    events: str = "input_event_seq",
) -> DataFrame:
    """Add ``output``: one float vector per window; ``events`` names the view of the events to score.

    ``make_predict_fn()`` runs once per Python worker and returns
    ``predict(events[b, length], products[b, length], feats[b, length, n_feats]) -> array[b, m]``.
    All key columns travel with the row, so scores need no re-association afterwards.
    """
    score = _scorer(make_predict_fn, FloatType(), [[length], [length], [length, n_feats]], batch_size)
    return padded.withColumn(output, score(*_inputs(events)))


def best_classes(make_predict_fn: Callable, n_scores: int) -> Callable:
    """The model with its scores reduced, inside the batch, to the best class of each position."""

    def make():
        predict = make_predict_fn()

        def reduced(events, products, feats):
            scores = predict(events, products, feats).reshape(*events.shape, n_scores)
            return scores.argmax(axis=-1).astype("int32")

        return reduced

    return make


def position_summaries(make_predict_fn: Callable, n_scores: int) -> Callable:
    """The model with its scores reduced, inside the batch, to three numbers per position.

    They are the best class, the score of the target (NaN if that is not a class) and the log-sum-exp of all
    scores, in double precision: all that reports and losses need, whatever the number of classes.
    """

    def make():
        import numpy as np

        predict = make_predict_fn()

        def reduced(events, products, feats, targets):
            scores = predict(events, products, feats).reshape(*events.shape, n_scores).astype("float64")
            target = targets.astype("int64")
            inside = (target >= 0) & (target < n_scores)
            own = np.take_along_axis(scores, np.where(inside, target, 0)[..., None], axis=-1)[..., 0]
            top = scores.max(axis=-1)
            lse = top + np.log(np.exp(scores - top[..., None]).sum(axis=-1))
            three = np.stack([scores.argmax(axis=-1).astype("float64"), np.where(inside, own, np.nan), lse], axis=-1)
            return three.reshape(len(events), -1)

        return reduced

    return make


def predict_events(
    padded: DataFrame,
    make_predict_fn: Callable,
    length: int,
    n_scores: int,
    n_feats: int = 3,
    batch_size: int = 256,
) -> DataFrame:
    """Add ``pred_event_seq``: the best class per position (the first on ties) of a model of ``n_scores`` classes.

    The model returns the scores of all positions in row-major order, ``length * n_scores`` floats; one
    number per position leaves the worker.
    """
    best = _scorer(best_classes(make_predict_fn, n_scores), IntegerType(), [[length], [length], [length, n_feats]], batch_size)
    return padded.withColumn("pred_event_seq", best(*_inputs()))


def score_positions(
    padded: DataFrame,
    make_predict_fn: Callable,
    length: int,
    n_scores: int,
    n_feats: int = 3,
    batch_size: int = 256,
) -> DataFrame:
    """One row (user_id, window_start, i, target, pred, target_score, log_sum) per position, padded ones included.

    ``target_score`` is null where the target is not a class of the model.
    """
    shapes = [[length], [length], [length, n_feats], [length]]
    score = _scorer(position_summaries(make_predict_fn, n_scores), DoubleType(), shapes, batch_size)
    scored = padded.withColumn("__three", score(*_inputs(), F.col("target_event_seq")))
    positions = F.arrays_zip(F.col("target_event_seq").alias("target"), rows_of(F.col("__three"), length, 3).alias("three"))
    three = [F.get("p.three", F.lit(j)) for j in range(3)]
    return scored.select("user_id", "window_start", F.posexplode(positions).alias("i", "p")).select(
        "user_id", "window_start", "i", F.col("p.target").cast("int").alias("target"), three[0].cast("int").alias("pred"),
        F.when(~F.isnan(three[1]), three[1]).alias("target_score"), three[2].alias("log_sum"),
    )


def position_logits(
    padded: DataFrame,
    make_predict_fn: Callable,
    length: int,
    n_scores: int,
    n_feats: int = 3,
    batch_size: int = 256,
) -> DataFrame:
    """One row (user_id, window_start, i, target, logits) per position, padded ones included.

    All ``n_scores`` scores of a position leave the worker; reports and losses do with :func:`score_positions`.
    """
    scored = score_windows(padded, make_predict_fn, "__scores", length, n_feats, batch_size)
    positions = F.arrays_zip(
        F.col("target_event_seq").alias("target"),
        rows_of(F.col("__scores"), length, n_scores).alias("logits"),
    )
    return scored.select("user_id", "window_start", F.posexplode(positions).alias("i", "p")).select(
        "user_id", "window_start", "i", F.col("p.target").cast("int").alias("target"), "p.logits"
    )
