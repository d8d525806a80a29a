import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventstrand.functions.sequences import argmax, mask_sequence, pad_right
from eventstrand.functions.vectors import l2_normalize
from eventstrand.operators.losses import batch_info_nce, focal_loss, info_nce
from eventstrand.operators.metrics import (
    class_weights,
    default_support,
    histogram,
    macro_weighted_metrics,
    per_class_report,
    prediction_pairs,
)


def test_default_class_weights(spark):
    rows = {r.event_type: r for r in class_weights(default_support(spark)).collect()}
    assert len(rows) == 22 and sum(r["count"] for r in rows.values()) == 1_166_326
    for event_type, weight in {0: 0.0, 2: 0.121015, 14: 10.924865, 21: 3.759260}.items():
        assert rows[event_type].weight == pytest.approx(weight, abs=5e-7)


def test_class_seen_only_as_prediction(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (2, 1)], "target int, pred int")
    report = per_class_report(pairs)
    rows = {r["class"]: tuple(r)[1:] for r in report.collect()}
    assert rows["3"] == (0.0, 0.0, 0.0, 0)
    summary = macro_weighted_metrics(report).first()
    assert summary.precision_macro == pytest.approx(0.5)
    assert summary.recall_macro == pytest.approx(1 / 3)
    assert summary.f1_macro == pytest.approx(0.388889, abs=1e-6)
    assert summary.recall_weighted == pytest.approx(0.5)


def test_no_predictions_at_all(spark):
    pairs = spark.createDataFrame([], "target int, pred int")
    assert tuple(macro_weighted_metrics(per_class_report(pairs)).first()) == (0.0,) * 6


def test_pairs_use_the_common_length_and_skip_padding(spark):
    df = spark.createDataFrame(
        [([1, 0, 3], [9, 9, 9, 9]), ([1, 2, 3], [9]), ([], [1])], "t array<int>, p array<int>"
    )
    assert [(r.target, r.pred) for r in prediction_pairs(df, "t", "p").collect()] == [(1, 9), (3, 9), (1, 9)]


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0],)], "s array<float>")
    assert [r[0] for r in df.select(argmax(F.col("s"))).collect()] == [1, 0]


def test_padding_never_shortens(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "s array<int>")
    assert [r[0] for r in df.select(pad_right(F.col("s"), 2, F.lit(0))).collect()] == [[1, 2, 3], [0, 0]]


def test_masking_is_seeded_and_near_its_rate(spark):
    df = spark.range(200).select("id", F.array_repeat(F.lit(5).cast("tinyint"), 50).alias("s"))

    def masked(p, seed):
        return [r[0] for r in df.select(mask_sequence(F.col("s"), p, seed, F.col("id"))).orderBy("id").collect()]

    once = masked(0.15, 1)
    assert once == masked(0.15, 1) != masked(0.15, 2)
    assert {e for seq in once for e in seq} == {0, 5}
    assert sum(seq.count(0) for seq in once) / 10_000 == pytest.approx(0.15, abs=0.015)
    assert masked(0.0, 1)[0] == [5] * 50 and masked(1.0, 1)[0] == [0] * 50


def test_masking_takes_four_positions_from_one_digest(spark):
    """Position i uses the (i mod 4)-th 32 bits of the digest of (key, i div 4)."""
    lengths = [0, 1, 3, 4, 5, 8, 41]
    df = spark.createDataFrame([(n, [7] * n) for n in lengths], "id bigint, s array<tinyint>")
    rows = df.select("id", mask_sequence(F.col("s"), 0.4, 3, F.col("id")).alias("m")).collect()
    for r in rows:
        digests = [hashlib.md5(f"3:{r.id}:{i // 4}".encode()).hexdigest() for i in range(r.id)]
        bits = [int(d[8 * (i % 4) : 8 * (i % 4) + 8], 16) for i, d in enumerate(digests)]
        assert r.m == [0 if b < 0.4 * 2**32 else 7 for b in bits]
    assert sorted(len(r.m) for r in rows) == lengths
    assert df.select(mask_sequence(F.lit(None).cast("array<tinyint>"), 0.4, 3).alias("m")).first().m is None


def test_masking_hashes_a_quarter_as_often(spark, plan_of):
    """The digest is bound once per block of four; inside a block only its text is cut."""
    text = str(mask_sequence(F.col("s"), 0.4, 3, F.col("id")))
    assert text.count("md5") == 1


def test_focal_loss_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scored = table.selectExpr("slice(embedding, 1, 22) logits", "int(if(vec_id % 11 = 0, 0, 1 + vec_id % 21)) target")
    weights = spark.range(22).selectExpr("int(id) event_type", "0.5 + 0.1D * id weight")
    got = focal_loss(scored, weights).first()
    rows = scored.toPandas()
    x = np.stack(rows["logits"].to_numpy()).astype("float64")
    t = rows["target"].to_numpy()
    ce = (0.5 + 0.1 * t) * (np.log(np.exp(x).sum(1)) - x[np.arange(len(t)), t])
    want = np.where(t == 0, 0.0, (1 - np.exp(-ce)) ** 2.5 * ce).mean()
    assert got.focal_loss == pytest.approx(want, rel=1e-9)
    if sf_dir.endswith("sf0.01"):
        assert got.focal_loss == pytest.approx(4.31589766, abs=1e-6)
    assert got.n_rows == len(t)


def test_focal_loss_of_large_scores_is_finite(spark):
    scored = spark.createDataFrame([([1000.0, -1000.0], 1)], "logits array<double>, target int")
    weights = spark.createDataFrame([(1, 1.0)], "event_type int, weight double")
    assert focal_loss(scored, weights).first().focal_loss == pytest.approx(2000.0)


def test_histogram_reads_its_input_once(spark, sf_dir, plan_of):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("double(embedding[0]) x")
    bins = histogram(table, "x", 7)
    assert "parquet" not in plan_of(bins).lower()
    rows, x = bins.orderBy("bin").collect(), np.array([r.x for r in table.collect()])
    assert [r.n for r in rows] == np.histogram(x, 7)[0].tolist()
    assert rows[0].lower == x.min() and rows[-1].upper == pytest.approx(x.max())
    assert [r.n for r in histogram(table.where("x > 9"), "x", 3).collect()] == [0, 0, 0]


def nce(a, b, temperature=0.07):
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    b = b / np.linalg.norm(b, axis=1, keepdims=True)
    s = a @ b.T / temperature
    return (np.log(np.exp(s).sum(1)) - s.diagonal()).mean()


def test_info_nce_of_one_batch(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = table.where("vec_id < 32").selectExpr("vec_id", "embedding view1", "0L batch_id")
    second = table.where("vec_id between 32 and 63").selectExpr("vec_id - 32 vec_id", "embedding view2")
    pairs = first.join(second, "vec_id")
    got = batch_info_nce(pairs, "view1", "view2").first()
    rows = pairs.toPandas()
    want = nce(*(np.stack(rows[c].to_numpy()).astype("float64") for c in ("view1", "view2")))
    assert got.n_rows == 32 and got.loss == pytest.approx(want, rel=1e-9)
    if sf_dir.endswith("sf0.01"):
        assert got.loss == pytest.approx(5.23957502, abs=1e-5)


def test_info_nce_is_the_mean_of_batch_means(spark):
    pairs = spark.range(7).selectExpr("id", "array(1D + id, 2D) a", "array(2D, 1D + id) b")
    got = info_nce(pairs, ["id"], "a", "b", batch_size=3, seed=5).first()
    assert got.n_batches == 3
    empty = info_nce(pairs.where("id < 0"), ["id"], "a", "b").first()
    assert tuple(empty) == (0.0, 0)


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(0).normal(size=1000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts, edges = np.histogram(values, bins=64)
    rows = histogram(df, "x").orderBy("bin").collect()
    assert [r.n for r in rows] == counts.tolist()
    assert [r.lower for r in rows] == pytest.approx(edges[:-1])
    single = histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r.n for r in single] == np.histogram([2.0, 2.0], bins=4)[0].tolist()


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r.v for r in l2_normalize(df, "v").collect()] == [[0.0, 0.0], [0.6, 0.8]]


@pytest.mark.parametrize(
    ("targets", "weights"),
    [([1, 2], [(1, 1.0)]), ([1, 3], [(1, 1.0), (2, 1.0), (3, 1.0)]), ([None], [(1, 1.0)]), ([-1], [(1, 1.0)]), ([1], [(1, 1.0), (1, 2.0)])],
)
def test_focal_loss_has_no_silent_gaps(spark, targets, weights):
    from eventstrand.operators.losses import focal_loss

    scored = spark.createDataFrame([([0.1, 0.2, 0.3], t) for t in targets], "logits array<float>, target int")
    table = spark.createDataFrame(weights, "event_type int, weight double")
    with pytest.raises(Exception, match="no weight for class|target outside the logits|two weights for class"):
        focal_loss(scored, table).collect()


def test_classes_without_support_count_once(spark):
    from eventstrand.operators.metrics import class_weights

    support = spark.createDataFrame([(1, 0), (2, 5)], "event_type int, support bigint")
    assert {r["event_type"]: r["count"] for r in class_weights(support).collect() if r["event_type"] in (1, 2, 3)} == {1: 1, 2: 5, 3: 1}
