"""User embeddings, k-means with choice of k, silhouettes, cluster profiles, 2-D projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from eventstrand.functions.sequences import PADDING
from eventstrand.functions.vectors import l2_normalize
from eventstrand.operators.kmeans import ClusterModel, full_fits, minibatch_fits, nearest, weighted_points
from eventstrand.operators.ranking import seeded_sample
from eventstrand.session import materialise

# Sizes used for the search, the final score and the scatter data.
SEARCH_SAMPLE = 5_000
SCORE_SAMPLE = 10_000
SCATTER_SAMPLE = 5_000
TOP_EVENTS = 5

_BLOCK_ROWS = 2_000


def user_mean_embedding(windows: DataFrame, column: str = "embedding") -> DataFrame:
    """Element-wise mean of a user's window vectors; partial sums are merged, not collected."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    return (
        windows.groupBy("user_id")
        .agg(Summarizer.mean(vector).alias("mean"))
        .select("user_id", vector_to_array("mean").alias("embedding"))
    )


def user_vectors(windows: DataFrame, column: str = "embedding") -> DataFrame:
    """(user_id, embedding, features): the mean scaled back to unit length, also as an ML vector."""
    unit = l2_normalize(user_mean_embedding(windows, column), "embedding")
    return unit.withColumn("features", array_to_vector("embedding"))


def kmeans_best_of(
    vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 100, column: str = "embedding"
) -> ClusterModel:
    """The k-means model with the smallest cost over ``n_init`` seeds (the earliest on ties).

    All starts advance in the same passes over one cached copy of the distinct vectors.  Fewer distinct
    vectors than k give fewer centres.
    """
    with weighted_points(vectors, column) as points:
        return min(full_fits(points, [(k, seed + i) for i in range(n_init)], max_iter), key=lambda model: model.cost)


def assign_clusters(model: ClusterModel, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Add ``cluster``: the number of the nearest centre."""
    return vectors.withColumn("cluster", F.get(nearest([model])(F.col(column).cast("array<double>")), F.lit(0)))


def silhouette_exact(
    clustered: DataFrame,
    key: str = "user_id",
    column: str = "embedding",
    sample_size: int = SCORE_SAMPLE,
    seed: int = 0,
) -> DataFrame:
    """Mean Euclidean silhouette of a seeded sample of (key, vector, cluster)."""
    points = seeded_sample(
        clustered.select(F.col(key).alias("id"), F.col(column).alias("v"), F.array("cluster").alias("labels")), ["id"], sample_size, seed
    )
    return silhouettes(points, sample_size).drop("clustering")


def silhouettes(points: DataFrame, sample_size: int) -> DataFrame:
    """(clustering, silhouette, n_points) for each element of ``labels`` of at most ``sample_size`` rows (id, v, labels).

    The points are cut into blocks by key hash; each pair of blocks is one matrix product in one task for all
    clusterings and leaves one row per (clustering, point, cluster), which are then added up.
    """
    n_blocks = math.ceil(sample_size / _BLOCK_ROWS)
    points = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1)))
    # a limited sample sits in one partition: without a partition count the products would stay there
    pairs = (n_blocks**2, "block", "other")
    left = points.select("id", "v", "labels", "block", others.alias("other")).repartition(*pairs)
    right = points.select("id", "v", "labels", others.alias("block"), F.col("block").alias("other")).repartition(*pairs)

    def distances(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["clustering", "id", "own", "cluster", "total", "n"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns}).astype({"total": "float64"})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        squared = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
        squared[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = 0.0
        distance = np.sqrt(np.maximum(squared, 0.0))
        own, other = np.stack(a["labels"].to_numpy()), np.stack(b["labels"].to_numpy())
        parts = []
        for j in range(own.shape[1]):
            labels, inverse, counts = np.unique(other[:, j], return_inverse=True, return_counts=True)
            totals = distance @ np.eye(len(labels))[inverse]
            parts.append(pd.DataFrame({
                "clustering": j,
                "id": np.repeat(a["id"].to_numpy(), len(labels)),
                "own": np.repeat(own[:, j], len(labels)),
                "cluster": np.tile(labels, len(a)),
                "total": totals.ravel(),
                "n": np.tile(counts, len(a)),
            }))
        return pd.concat(parts)[columns]

    totals = (
        left.groupBy("block", "other")
        .cogroup(right.groupBy("block", "other"))
        .applyInPandas(distances, "clustering int, id bigint, own int, cluster int, total double, n bigint")
        .groupBy("clustering", "id", "own", "cluster")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    is_own = F.col("cluster") == F.col("own")
    per_point = totals.groupBy("clustering", "id", "own").agg(
        F.max(F.when(is_own, F.col("n"))).alias("own_n"),
        F.max(F.when(is_own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b"),
    )
    width = F.when(F.col("own_n") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_point.groupBy("clustering").agg(F.avg(width).alias("silhouette"), F.count(F.lit(1)).alias("n_points"))


def silhouette_squared(clustered: DataFrame) -> float:
    """Silhouette on squared Euclidean distance over all rows, linear in their number.

    Another statistic than :func:`silhouette_exact`; do not compare the two.
    """
    evaluator = ClusteringEvaluator(
        featuresCol="features", predictionCol="cluster", distanceMeasure="squaredEuclidean"
    )
    return evaluator.evaluate(clustered)


def search_k(
    vectors: DataFrame,
    k_min: int,
    k_max: int,
    step: int = 2,
    n_init: int = 3,
    seed: int = 42,
    sample_size: int = SEARCH_SAMPLE,
    key: str = "user_id",
    column: str = "embedding",
    **batches,
) -> DataFrame:
    """(k, silhouette, is_best) for k_min, k_min + step, ... <= k_max; the lowest k wins ties.

    Mini-batch k-means: all starts of all k share every pass.  One sample is drawn and scored for all k.
    """
    ks = list(range(k_min, k_max + 1, step))
    with weighted_points(vectors, column) as points:
        fits = minibatch_fits(points, [(k, seed + i) for k in ks for i in range(n_init)], seed=seed, **batches)
    models = [min(fits[i * n_init : (i + 1) * n_init], key=lambda model: model.cost) for i in range(len(ks))]
    v = F.col(column).cast("array<double>")
    sample = seeded_sample(vectors.select(F.col(key).alias("id"), v.alias("v")).where(v.isNotNull()), ["id"], sample_size, 0)
    labelled = materialise(sample.withColumn("labels", nearest(models)("v")))
    scores = {r.clustering: r.silhouette for r in silhouettes(labelled, sample_size).collect()}
    best = max(range(len(ks)), key=lambda i: scores[i])
    return vectors.sparkSession.createDataFrame(
        [(k, scores[i], i == best) for i, k in enumerate(ks)], "k int, silhouette double, is_best boolean"
    )


def cluster_distribution(clusters: DataFrame) -> DataFrame:
    """Users per cluster and their share, largest first (one row per cluster)."""
    counts = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_users"))
    total = F.sum("n_users").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n_users") / total).orderBy(F.desc("n_users"), "cluster")


def cluster_event_counts(windows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Events per (cluster, event type) over all window inputs, padding and unmatched users left out.

    Events are counted per (user, type) before the join, so a hot user joins as a handful of rows.
    """
    per_user = (
        windows.select("user_id", F.explode("input_event_seq").alias("event_type"))
        .where(F.col("event_type") > PADDING)
        .groupBy("user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_user.join(clusters.select("user_id", "cluster"), "user_id")
        .groupBy("cluster", "event_type")
        .agg(F.sum("n").alias("n_events"))
    )


def cluster_top_events(counts: DataFrame, top: int = TOP_EVENTS) -> DataFrame:
    """``ev_17 40% | ev_1 35% | ...`` per cluster, most frequent first."""
    ranked = counts.select(
        "*",
        F.row_number()
        .over(Window.partitionBy("cluster").orderBy(F.desc("n_events"), "event_type"))
        .alias("rank"),
        F.sum("n_events").over(Window.partitionBy("cluster")).alias("total"),
    ).where(F.col("rank") <= top)
    percent = F.bround(F.col("n_events") / F.col("total") * 100).cast("int")
    label = F.format_string("ev_%d %d%%", F.col("event_type").cast("int"), percent)
    return ranked.groupBy("cluster").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", label.alias("label"))))["label"], " | ").alias(
            "top_events"
        )
    )


def pca_2d(vectors: DataFrame) -> DataFrame:
    """Centred projection on two components, with the explained share of variance in percent."""
    centred = (
        StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred")
        .fit(vectors)
        .transform(vectors)
    )
    model = PCA(k=2, inputCol="centred", outputCol="projected").fit(centred)
    xy = vector_to_array("projected")
    return model.transform(centred).select(
        *[c for c in vectors.columns if c not in ("features", "embedding")],
        xy[0].alias("pc1"),
        xy[1].alias("pc2"),
        F.lit(float(model.explainedVariance.toArray().sum() * 100)).alias("explained_percent"),
    )
