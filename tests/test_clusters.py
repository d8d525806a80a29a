import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from eventstrand.adapters import window_embeddings
from eventstrand.operators import clusters, kmeans


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return clusters.user_vectors(window_embeddings(table)).persist()


def silhouette(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def points(spark, x, labels):
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "user_id bigint, embedding array<double>, cluster int")


def test_silhouette_with_a_singleton_cluster(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(61, 5)), np.append(rng.integers(0, 4, 60), 9)
    monkeypatch.setattr(clusters, "_BLOCK_ROWS", 10)  # several blocks
    got = clusters.silhouette_exact(points(spark, x, labels), sample_size=100).first()
    assert got.n_points == 61 and got.silhouette == pytest.approx(silhouette(x, labels), abs=1e-9)


def test_silhouette_of_a_sample(spark):
    rng = np.random.default_rng(2)
    x, labels = rng.normal(size=(80, 3)), rng.integers(0, 3, 80)
    assert clusters.silhouette_exact(points(spark, x, labels), sample_size=30).first().n_points == 30


def test_silhouette_blocks_are_spread_over_tasks(spark, plan_of):
    clustered = points(spark, np.eye(4), [0, 0, 1, 1])
    plan = plan_of(clusters.silhouette_exact(clustered, sample_size=10_000))
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_user_mean_is_renormalised(vectors):
    rows = vectors.collect()
    assert np.allclose([np.linalg.norm(r.embedding) for r in rows], 1.0)


def blobs(spark, seed, n_groups=12, size=40, repeats=1):
    """Groups that lie near each other, so that fits end in different local optima."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.6, size=(size, 3)) for c in rng.uniform(-4, 4, size=(n_groups, 3))])
    return x, points(spark, np.repeat(x, repeats, axis=0), np.zeros(len(x) * repeats)).drop("cluster").persist()


def cost_of(x, centers):
    return float(((x[:, None, :] - centers[None]) ** 2).sum(-1).min(1).sum())


def test_kmeans_is_repeatable_and_the_best_of_its_seeds(spark):
    x = np.random.default_rng(3).uniform(size=(150, 2))  # no groups: every start ends elsewhere
    df = points(spark, x, np.zeros(len(x))).drop("cluster").persist()
    model = clusters.kmeans_best_of(df, k=8, n_init=4, seed=5)
    again = clusters.kmeans_best_of(df.repartition(7), k=8, n_init=4, seed=5)
    assert np.allclose(model.centers, again.centers)
    single = [clusters.kmeans_best_of(df, k=8, n_init=1, seed=5 + i) for i in range(4)]
    assert model.cost == pytest.approx(min(m.cost for m in single))
    costs = [m.cost for m in single]
    assert costs.index(min(costs)) > 0 and min(costs) < costs[0] * 0.999  # the first is not the best
    assert model.cost == pytest.approx(cost_of(x, model.centers))
    assigned = clusters.assign_clusters(model, df).collect()
    want = ((x[:, None, :] - model.centers[None]) ** 2).sum(-1).argmin(1)
    assert [r.cluster for r in sorted(assigned, key=lambda r: r.user_id)] == want.tolist()


def test_kmeans_is_as_good_as_the_ml_library(spark, vectors):
    _, df = blobs(spark, 4)
    ml = df.withColumn("features", array_to_vector("embedding"))
    theirs = min(KMeans(k=12, seed=i, maxIter=100).fit(ml).summary.trainingCost for i in range(5))
    assert clusters.kmeans_best_of(df, k=12, n_init=5).cost <= theirs * 1.02
    model = clusters.kmeans_best_of(vectors, k=4, n_init=3)
    assigned = clusters.assign_clusters(model, vectors)
    assert {r.cluster for r in assigned.select("cluster").distinct().collect()} == set(range(4))
    assert assigned.count() == vectors.count()


def test_passes_do_not_grow_with_the_starts(spark, monkeypatch):
    _, df = blobs(spark, 6)
    calls = []
    monkeypatch.setattr(kmeans, "_pass", lambda points, starts, real=kmeans._pass: calls.append(len(starts)) or real(points, starts))
    one = [clusters.kmeans_best_of(df, k=6, n_init=1, seed=i) and len(calls) for i in range(3)]
    longest = max(b - a for a, b in zip([0, *one], one))
    del calls[:]
    clusters.kmeans_best_of(df, k=6, n_init=3, seed=0)
    assert len(calls) <= longest and calls[0] == 3


def test_minibatches_cost_nearly_as_little_as_full_fits(spark):
    _, df = blobs(spark, 7, n_groups=6, size=300)
    with kmeans.weighted_points(df) as pts:
        settings = [(k, seed) for k in (4, 6) for seed in range(3)]
        full = kmeans.full_fits(pts, settings)
        small = kmeans.minibatch_fits(pts, settings, batch_points=150, steps=30)
    for k in (4, 6):
        best = [min(m.cost for m in models if m.k == k) for models in (full, small)]
        assert best[1] <= best[0] * 1.05


def test_sums_may_be_merged_by_spark(spark, monkeypatch):
    _, df = blobs(spark, 9, n_groups=4, size=50)
    once = clusters.kmeans_best_of(df, k=4, n_init=2)
    monkeypatch.setattr(kmeans, "MERGED_NUMBERS", 0)
    again = clusters.kmeans_best_of(df, k=4, n_init=2)
    assert np.allclose(once.centers, again.centers) and once.cost == pytest.approx(again.cost)


def test_equal_vectors_weigh_as_often_as_they_come(spark):
    x, once = blobs(spark, 8, n_groups=4, size=30)
    _, often = blobs(spark, 8, n_groups=4, size=30, repeats=5)
    a, b = (clusters.kmeans_best_of(df, k=4, n_init=4) for df in (once, often))
    assert b.cost == pytest.approx(5 * a.cost, rel=0.02)
    few = points(spark, np.repeat(np.eye(3), 50, axis=0), np.zeros(150)).drop("cluster")
    model = clusters.kmeans_best_of(few, k=5, n_init=2)  # fewer distinct vectors than k
    assert model.k == 3 and model.cost == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError, match="no vectors"):
        clusters.kmeans_best_of(few.where("user_id < 0"), k=2)


def test_search_prefers_the_true_number_of_groups(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, size=(30, 2)) for c in ((0, 0), (0, 5), (5, 0), (5, 5))])
    df = points(spark, x, np.zeros(len(x))).drop("cluster").withColumn("features", array_to_vector("embedding"))
    rows = clusters.search_k(df, 2, 7).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 4, 6]
    assert [r.is_best for r in rows] == [False, True, False]
    assert rows[1].silhouette > 0.9


def test_scalable_silhouette_is_bounded(vectors):
    clustered = vectors.withColumn("cluster", (F.col("user_id") % 3).cast("int"))
    assert -1.0 <= clusters.silhouette_squared(clustered) <= 1.0


def test_pca_equals_numpy(vectors):
    got = clusters.pca_2d(vectors).orderBy("user_id").toPandas()
    x = np.stack([r.embedding for r in vectors.orderBy("user_id").collect()])
    centred = x - x.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got[["pc1", "pc2"]]), np.abs(centred @ axes[:2].T), atol=1e-8)
    assert got["explained_percent"][0] == pytest.approx(100 * (s[:2] ** 2).sum() / (s**2).sum())
    assert list(got.columns) == ["user_id", "pc1", "pc2", "explained_percent"]


def test_profile(spark):
    windows = spark.createDataFrame(
        [(1, [1, 1, 2, 0]), (1, [3]), (2, [5]), (9, [7])], "user_id bigint, input_event_seq array<tinyint>"
    )
    users = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "user_id bigint, cluster int")
    counts = clusters.cluster_event_counts(windows, users)
    top = {r.cluster: r.top_events for r in clusters.cluster_top_events(counts, 2).collect()}
    assert top == {0: "ev_1 50% | ev_2 25%", 1: "ev_5 100%"}
    sizes = [tuple(r) for r in clusters.cluster_distribution(users).collect()]
    assert sizes == [(1, 2, pytest.approx(2 / 3)), (0, 1, pytest.approx(1 / 3))]


def test_percent_rounds_half_to_even(spark):
    counts = spark.createDataFrame([(0, 1, 125), (0, 2, 135), (0, 3, 740)], "cluster int, event_type int, n_events bigint")
    # 12.5 -> 12 and 13.5 -> 14
    assert clusters.cluster_top_events(counts).first().top_events == "ev_3 74% | ev_2 14% | ev_1 12%"
