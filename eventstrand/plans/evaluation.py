"""Scored windows to classification and clustering reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from eventstrand.functions.sequences import PADDING
from eventstrand.functions.vectors import l2_normalize
from eventstrand.operators.clusters import (
    SCATTER_SAMPLE,
    assign_clusters,
    cluster_distribution,
    cluster_event_counts,
    cluster_top_events,
    kmeans_best_of,
    pca_2d,
    search_k,
    silhouette_exact,
    silhouette_squared,
    user_vectors,
)
from eventstrand.operators.inference import score_positions, score_windows
from eventstrand.operators.losses import TEMPERATURE, focal_positions, info_nce, mean_loss
from eventstrand.operators.metrics import (
    histogram,
    macro_weighted_metrics,
    pair_cosine,
    report_of_confusion,
)
from eventstrand.operators.ranking import seeded_sample
from eventstrand.operators.tensors import mask_events
from eventstrand.plans.training import VAL_MASK
from eventstrand.session import materialise


def evaluate_predictions(
    padded: DataFrame,
    make_predict_fn: Callable,
    length: int,
    n_scores: int,
    n_feats: int = 3,
    weights: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Next-event model: per-class table, macro/weighted summary and, given class weights, focal loss.

    Three numbers per position leave the model's worker.  One pass reduces them to confusion counts with loss
    sums; everything else is computed from that checkpointed little table, so the model runs once.
    """
    positions = score_positions(padded, make_predict_fn, length, n_scores, n_feats)
    loss = F.lit(0.0)
    if weights is not None:
        positions, loss = focal_positions(positions, weights), F.col("focal")
    totals = materialise(
        positions.groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("focal"))
    )
    report = report_of_confusion(totals.where(F.col("target") != PADDING))
    reports = {"per_class": report, "summary": macro_weighted_metrics(report)}
    if weights is not None:
        reports["loss"] = totals.agg(
            mean_loss(F.sum("focal"), F.sum("n")).alias("focal_loss"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")
        )
    return reports


def evaluate_contrastive(
    padded: DataFrame,
    make_predict_fn: Callable,
    length: int,
    n_feats: int = 3,
    batch_size: int = 512,
    temperature: float = TEMPERATURE,
    mask_probability: float = VAL_MASK,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Embedding model on each window and its masked view: loss, mean cosine and cosine histogram.

    The two vectors per window are checkpointed, so the model runs once per view.
    """
    views = mask_events(padded, mask_probability, seed)
    for name, events in (("view1", "input_event_seq"), ("view2", "input_event_seq_v2")):
        views = score_windows(views, make_predict_fn, name, length, n_feats, events=events)
    pairs = views.select("user_id", "window_start", "view1", "view2")
    pairs = materialise(l2_normalize(l2_normalize(pairs, "view1"), "view2"))
    cosines = pair_cosine(pairs, "view1", "view2")
    return {
        "loss": info_nce(
            pairs, ["user_id", "window_start"], "view1", "view2", batch_size, temperature, seed
        ),
        "cosine": cosines.agg(
            F.coalesce(F.avg("cosine"), F.lit(0.0)).alias("mean_cosine"), F.count("cosine").alias("n_pairs")
        ),
        "histogram": histogram(cosines, "cosine"),
    }


def evaluate_embeddings(
    padded: DataFrame,
    make_predict_fn: Callable,
    length: int,
    k: int = 8,
    k_range: tuple[int, int] | None = None,
    n_feats: int = 3,
    n_init: int = 10,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Embedding model: user clusters, their silhouette, sizes, top events and 2-D points.

    The user vectors are checkpointed once; every k-means pass and report reads them from there.
    """
    scored = score_windows(padded, make_predict_fn, "embedding", length, n_feats)
    vectors = materialise(user_vectors(scored))
    reports = {}
    if k_range is not None:
        reports["k_search"] = search_k(vectors, *k_range, seed=seed)
        k = reports["k_search"].where("is_best").first().k
    clusters = assign_clusters(kmeans_best_of(vectors, k, n_init, seed), vectors)
    reports["clusters"] = clusters.select("user_id", "cluster")
    all_rows = F.lit(silhouette_squared(clusters)), F.lit(vectors.count())
    reports["silhouette"] = silhouette_exact(clusters).select(
        "*", all_rows[0].alias("silhouette_squared"), all_rows[1].cast("bigint").alias("n_users")
    )
    reports["distribution"] = cluster_distribution(clusters)
    reports["top_events"] = cluster_top_events(cluster_event_counts(padded, clusters))
    reports["points"] = seeded_sample(pca_2d(clusters), ["user_id"], SCATTER_SAMPLE, seed)
    return reports
