import json
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventstrand.adapters import TEST_MEAN, TEST_SPEC, TEST_STD, hash_split, raw_events
from eventstrand.catalog.queries import QUERIES
from eventstrand.catalog.scorers import EMBEDDING_SIZE, N_SCORES, embedding_model, next_event_model
from eventstrand.operators.inference import (
    best_classes, position_logits, position_summaries, predict_events, score_positions, score_windows,
)
from eventstrand.operators.splits import distinct_users, train_val_rows
from eventstrand.operators.tensors import pad_windows
from eventstrand.plans.evaluation import evaluate_embeddings, evaluate_predictions
from eventstrand.plans.preprocess import build_bucketed_windows, build_windows, write_dataset
from eventstrand.plans.training import training_tables
from eventstrand.session import materialise, shared_dir
from eventstrand.sources import sinks, tables

N = TEST_SPEC.length


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


@pytest.fixture(scope="module")
def dataset(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dataset"))
    write_dataset(raw, path, 5, TEST_SPEC, value_mean=TEST_MEAN, value_std=TEST_STD)
    return path


def test_first_files_in_name_order(spark, tmp_path):
    for i in range(4):
        spark.range(i, i + 1).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
        (part,) = [f for f in os.listdir(f"{tmp_path}/tmp{i}") if f.endswith(".parquet")]
        os.link(f"{tmp_path}/tmp{i}/{part}", f"{tmp_path}/batch_{i}.parquet")
    (tmp_path / "notes.txt").write_text("not a table")
    flat = str(tmp_path)
    assert sorted(r.id for r in tables.read_first_files(spark, f"{flat}/batch_*.parquet", 2).collect()) == [0, 1]
    scan = tables.read_parquet_folder(spark, flat, "batch_*.parquet")
    assert sorted(r.id for r in scan.collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        tables.read_first_files(spark, flat, 0)


def test_split_lists_and_rows(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"train": [1, 2], "test": [3]}, indent=2))
    got = tables.read_split_lists(spark, f"{tmp_path}/split.json")
    assert {tuple(r) for r in got.collect()} == {(1, "train"), (2, "train"), (3, "test")}
    got.write.json(f"{tmp_path}/rows")
    assert tables.read_split_rows(spark, f"{tmp_path}/rows").exceptAll(got).isEmpty()


def test_split_documents_are_many_and_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sinks, "USERS_PER_DOCUMENT", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        got = QUERIES["uid_split_document"](spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    users = got.count()
    files = got.inputFiles()
    lines = [json.loads(x.value) for x in spark.read.text(files).collect()]
    assert len(files) > 1 and len(lines) > 1
    sizes = [len(x.get("train", [])) + len(x.get("test", [])) for x in lines]
    assert sum(sizes) == users and max(sizes) <= 60


def test_first_files_may_be_folders_of_several_files(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        got = QUERIES["first_files_scan"](spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(got.inputFiles()) > 3
    assert {r.file for r in got.select("file").distinct().collect()} == {0, 1, 2}


def test_report_sink(spark, tmp_path):
    report = spark.createDataFrame([("1", 0.5), ("2", 0.25)], "class string, f1 double")
    sinks.write_report(report, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, inferSchema=True)
    assert {tuple(r) for r in back.collect()} == {(1, 0.5), (2, 0.25)}
    sinks.write_report(report, f"{tmp_path}/pq", "parquet")
    assert spark.read.parquet(f"{tmp_path}/pq").exceptAll(report).isEmpty()


def test_dataset_on_disk(spark, raw, dataset):
    stored = spark.read.parquet(f"{dataset}/windows")
    built = build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD)
    assert stored.drop("bucket").exceptAll(built).isEmpty() and stored.count() == built.count()
    assert {r.bucket for r in stored.select("bucket").distinct().collect()} == set(range(5))
    names = [f for _, _, files in os.walk(f"{dataset}/windows") for f in files if f.endswith(".parquet")]
    assert names and all(".zstd." in f for f in names)
    vocabulary = spark.read.parquet(f"{dataset}/vocabulary")
    n = vocabulary.count()
    assert {r.new_id for r in vocabulary.collect()} == set(range(1, n + 1))


def test_many_buckets(spark, raw, tmp_path):
    """More buckets than shuffle partitions, one part each: one file per bucket for ordinary users."""
    stored = write_dataset(raw, str(tmp_path), 24, TEST_SPEC, parts=1, value_mean=TEST_MEAN, value_std=TEST_STD)
    built = build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD)
    assert stored.drop("bucket").exceptAll(built).isEmpty() and stored.count() == built.count()
    assert len(stored.inputFiles()) == stored.select("bucket").distinct().count()


def test_failed_buckets_are_retried(spark, raw, tmp_path):
    path, markers = f"{tmp_path}/windows", f"{tmp_path}/done"
    seen = []

    def build(part, fail_on=(1,)):
        bucket = part.first().bucket
        seen.append(bucket)
        if bucket in fail_on:
            raise RuntimeError("no luck")
        return build_bucketed_windows(part, TEST_SPEC, max_events=70)

    with pytest.raises(sinks.IncompleteDataset, match=r"\[1\]") as failure:
        sinks.write_resumable(raw, build, path, markers, 4, buckets_per_job=1)
    assert str(failure.value.__cause__) == "no luck"
    assert [r.bucket for r in sinks.pending_buckets(spark, markers, 4).collect()] == [1]
    # leftovers of a bucket that was not marked done are replaced
    sinks.write_buckets(sinks.with_bucket(build_windows(raw, TEST_SPEC), 4).where("bucket = 1").limit(3), path)
    del seen[:]
    assert sinks.write_resumable(raw, lambda p: build(p, ()), path, markers, 4, buckets_per_job=1) == [1]
    assert seen == [1]
    assert sinks.write_resumable(raw, build, path, markers, 4) == []
    stored = spark.read.parquet(path).drop("bucket")
    built = build_windows(raw, TEST_SPEC)
    assert stored.count() == built.count() and stored.exceptAll(built).isEmpty()
    assert not os.path.exists(f"{markers}-staged")


def test_an_incomplete_dataset_has_no_vocabulary(spark, raw, tmp_path, monkeypatch):
    path = str(tmp_path)
    options = {"value_mean": TEST_MEAN, "value_std": TEST_STD, "buckets_per_job": 2, "source": "test"}

    def fail(bucketed, target, write=sinks.write_buckets):
        if target.endswith("windows") and bucketed.where("bucket = 3").count():
            raise RuntimeError("disk full")
        write(bucketed, target)

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "write_buckets", fail)
        with pytest.raises(sinks.IncompleteDataset):
            write_dataset(raw, path, 5, TEST_SPEC, **options)
    assert not os.path.exists(f"{path}/vocabulary")
    stored = write_dataset(raw, path, 5, TEST_SPEC, **options)
    built = build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD)
    assert stored.drop("bucket").exceptAll(built).isEmpty() and stored.count() == built.count()
    before = {f: os.path.getmtime(f"{path}/vocabulary/{f}") for f in os.listdir(f"{path}/vocabulary")}
    write_dataset(raw, path, 5, TEST_SPEC, **options)
    assert before == {f: os.path.getmtime(f"{path}/vocabulary/{f}") for f in os.listdir(f"{path}/vocabulary")}
    counts = spark.read.parquet(f"{path}/user_counts").first()
    assert counts.users_kept == distinct_users(raw).count() and counts.users_dropped == 0


@pytest.mark.parametrize("change", [{"n_buckets": 10}, {"length": 80}, {"value_mean": 1.0}, {"source": "other"}])
def test_a_dataset_is_not_resumed_with_other_settings(raw, tmp_path, change):
    few = raw.where("user_id < 5")
    options = {"n_buckets": 5, "value_mean": TEST_MEAN, "value_std": TEST_STD, "source": "test"}
    write_dataset(few, str(tmp_path), spec=TEST_SPEC, **options)
    spec = replace(TEST_SPEC, length=change.pop("length", TEST_SPEC.length))
    with pytest.raises(ValueError, match="was begun with"):
        write_dataset(few, str(tmp_path), spec=spec, **{**options, **change})


def test_a_dataset_is_not_resumed_with_other_rows(spark, raw, tmp_path):
    few = raw.where("user_id < 12")
    split = hash_split(distinct_users(few)).persist()
    options = {"n_buckets": 4, "spec": TEST_SPEC, "value_mean": TEST_MEAN, "value_std": TEST_STD}
    write_dataset(few, str(tmp_path), split=split, **options)
    moved = split.withColumn("split", F.when(F.col("user_id") == 3, F.when(F.col("split") == "test", "train").otherwise("test")).otherwise(F.col("split")))
    last = few.agg(F.max("event_id")).first()[0]
    changes = {
        "split": (few, moved),
        "value": (few.withColumn("value", F.when(F.col("event_id") == last, F.lit(None)).otherwise(F.col("value"))), split),
        "missing": (few.where(F.col("event_id") != last), split),
        "doubled": (few.union(few.where(F.col("event_id") == last)), split),
    }
    for events, users in changes.values():
        with pytest.raises(ValueError, match="rows of 1 buckets"):
            write_dataset(events, str(tmp_path), split=users, **options)
    # the same rows in another order, other partitions and another order of columns are the same input
    again = few.select(*reversed(few.columns)).repartition(5, "value")
    assert write_dataset(again, str(tmp_path), split=split.repartition(3), **options).count() > 0


def test_done_buckets_of_unknown_rows_are_refused(spark, raw, tmp_path):
    spark.createDataFrame([(1,)], "bucket int").write.json(f"{tmp_path}/done")
    with pytest.raises(ValueError, match="does not say from which rows"):
        sinks.write_resumable(raw, lambda part: part, f"{tmp_path}/out", f"{tmp_path}/done", 4)


def test_fingerprint_tells_nulls_apart(spark):
    rows = [[(1, None, 5)], [(1, 5, None)], [(1, 5, 5)]]
    prints = [sinks.fingerprint(spark.createDataFrame(r, "bucket int, a int, b int")).first().row_hash for r in rows]
    assert len(set(prints)) == 3


@pytest.mark.parametrize("n_buckets", [2, 50])
def test_writing_by_bucket_needs_one_shuffle(raw, plan_of, n_buckets):
    bucketed = sinks.with_part(sinks.with_bucket(raw, n_buckets), 16)
    plan = plan_of(build_bucketed_windows(bucketed, TEST_SPEC))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan
    heavy = plan_of(build_bucketed_windows(bucketed, TEST_SPEC, max_events=70))
    assert "REBALANCE_PARTITIONS_BY_COL" in heavy


def test_a_split_on_the_events_is_stored_for_pruning(spark, raw, tmp_path, plan_of):
    split = hash_split(distinct_users(raw))
    stored = write_dataset(raw, str(tmp_path), 4, TEST_SPEC, split=split, value_mean=TEST_MEAN, value_std=TEST_STD)
    windows = build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD)
    got = train_val_rows(stored).drop("bucket")
    want = train_val_rows(sinks.with_bucket(windows, 4), split).drop("bucket")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()
    assert "PartitionFilters: [isnotnull(split" in plan_of(stored.where("split = 'test'"))


def test_attaching_a_split_to_events_adds_no_wide_shuffle(spark, raw, plan_of):
    events = raw.join(hash_split(distinct_users(raw)), "user_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(build_windows(events, TEST_SPEC))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # events once by user; the users of the split are shuffled on their own
    assert plan.count("Exchange hashpartitioning(user_id") <= 2 and "num_feats" not in plan.split("SortMergeJoin")[-1]


def test_batches_are_placed_before_lists_are_transformed(spark, raw, dataset, plan_of):
    windows, vocabulary = spark.read.parquet(f"{dataset}/windows"), spark.read.parquet(f"{dataset}/vocabulary")
    table = training_tables(windows, hash_split(distinct_users(raw)), vocabulary, N, batch_size=16)["train"]
    plan = plan_of(table)
    last_exchange = plan.index("Exchange hashpartitioning(__prefix")
    assert "input_event_seq_v2" in plan[:last_exchange] and "input_event_seq_v2" not in plan[last_exchange:]
    assert "ArrowEvalPython" not in plan[last_exchange:]


def test_training_tables(spark, raw, dataset):
    windows = spark.read.parquet(f"{dataset}/windows")
    vocabulary = spark.read.parquet(f"{dataset}/vocabulary")
    split = hash_split(distinct_users(raw))
    sides = training_tables(windows, split, vocabulary, N, batch_size=16, with_balance=False)
    train, val = sides["train"].collect(), sides["val"].collect()
    assert train and val and not {r.user_id for r in train} & {r.user_id for r in val}
    for r in train + val:
        assert len(r.input_event_seq) == len(r.input_product_seq) == len(r.target_event_seq) == N
        assert len(r.input_event_seq_v2) == N and {len(f) for f in r.num_feats_seq} == {2}
    sizes = [sum(r.batch_id == b for r in train) for b in {r.batch_id for r in train}]
    assert sizes[:-1] == [16] * (len(sizes) - 1)
    masked = [sum(a != b for a, b in zip(r.input_event_seq, r.input_event_seq_v2)) / N for r in train]
    assert 0.3 < np.mean(masked) < 0.5
    known = vocabulary.count()
    assert {p for r in train for p in r.input_product_seq} <= set(range(known + 1))


def test_scores_equal_the_model_called_directly(raw):
    padded = pad_windows(build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD), N)
    scored = score_windows(padded, embedding_model(), "embedding", N, batch_size=7).collect()
    events = np.array([r.input_event_seq for r in scored])
    products = np.array([r.input_product_seq for r in scored])
    feats = np.array([r.num_feats_seq for r in scored])
    assert feats.shape[1:] == (N, 3)
    want = embedding_model()()(events, products, feats)
    assert np.array_equal(np.array([r.embedding for r in scored], dtype="float32"), want)
    predicted = predict_events(padded, next_event_model(), N, N_SCORES).collect()
    direct = next_event_model()()(
        np.array([r.input_event_seq for r in predicted]), np.array([r.input_product_seq for r in predicted]),
        np.array([r.num_feats_seq for r in predicted]),
    ).reshape(len(predicted), N, N_SCORES)
    assert np.array_equal([r.pred_event_seq for r in predicted], direct.argmax(-1))


def test_the_model_runs_once(raw, plan_of):
    padded = pad_windows(build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD), N)
    scored = score_windows(padded, embedding_model(), "embedding", N)
    assert plan_of(scored.select("user_id", F.explode("embedding"))).count("ArrowEvalPython") == 1
    positions = score_positions(padded, next_event_model(), N, N_SCORES)
    assert plan_of(positions.where("target <> 0")).count("ArrowEvalPython") == 1


def test_three_numbers_of_a_position_leave_the_worker(raw, plan_of):
    """As many as that whatever the number of classes, and one for the best class alone."""
    padded = pad_windows(build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD), N)
    one = padded.orderBy("user_id", "window_start").limit(1)
    for n_scores in (N_SCORES, 500):
        three = position_summaries(next_event_model(n_scores), n_scores)()
        r = one.first()
        inputs = [np.array([x]) for x in (r.input_event_seq, r.input_product_seq, r.num_feats_seq)]
        assert three(*inputs, np.array([r.target_event_seq])).shape == (1, 3 * N)
        assert best_classes(next_event_model(n_scores), n_scores)()(*inputs).shape == (1, N)
    plan = plan_of(score_positions(padded, next_event_model(), N, N_SCORES))
    assert plan.count("ArrowEvalPython") == 1 and "logits" not in plan


def test_position_scores_are_those_of_the_logits(raw):
    padded = pad_windows(build_windows(raw.where("user_id < 9"), TEST_SPEC, TEST_MEAN, TEST_STD), N)
    key = lambda r: (r.user_id, r.window_start, r.i)
    scored = {key(r): r for r in score_positions(padded, next_event_model(), N, N_SCORES).collect()}
    logits = position_logits(padded, next_event_model(), N, N_SCORES).collect()
    assert len(logits) == len(scored) > 0
    for r in logits:
        x, got = np.array(r.logits, dtype="float64"), scored[key(r)]
        assert (got.target, got.pred) == (r.target, int(x.argmax()))
        assert got.target_score == x[r.target] and got.log_sum == pytest.approx(np.log(np.exp(x).sum()))
    # fewer classes than the targets say: no score, and an error rather than a missing row
    few = score_positions(padded, next_event_model(3), N, 3)
    assert few.where("target >= 3 AND target_score IS NOT NULL").count() == 0 < few.where("target >= 3").count()


def test_evaluation_flows(raw):
    padded = pad_windows(build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD), N)
    scores = evaluate_predictions(padded, next_event_model(), N, N_SCORES)
    assert 0 <= scores["summary"].first().recall_macro <= 1
    reports = evaluate_embeddings(padded, embedding_model(), N, k_range=(2, 4), n_init=2)
    best = reports["k_search"].where("is_best").first().k
    assert reports["distribution"].count() == best
    users = distinct_users(raw).count()
    assert reports["clusters"].count() == reports["points"].count() == users
    assert reports["silhouette"].first().n_points == users
    assert reports["top_events"].count() == best
    assert EMBEDDING_SIZE == 8


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + shared_dir(spark))
    assert materialise(spark.range(5)).where(F.col("id") > 2).count() == 2
