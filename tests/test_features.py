import math
import os
import random

import pytest
from pyspark.sql import functions as F

from eventstrand.operators.features import event_features, normalise_events
from eventstrand.operators.histories import split_histories
from eventstrand.operators.windows import WindowSpec
from eventstrand.plans.preprocess import build_windows, features_of, prepare_dataset


def balances(features):
    rows = features.rows().orderBy("user_id", "pos").collect()
    return {u: [r.balance for r in rows if r.user_id == u] for u in {r.user_id for r in rows}}


def test_unknown_flow_makes_the_next_balance_zero(events_of):
    raw = events_of(
        [(1, 0, 10.0, 3, 1), (1, 1, None, 3, 1), (1, 2, 5.0, 3, 1), (1, 3, 1.0, 3, 1), (2, 0, 7.0, 3, 1)]
    )
    assert balances(features_of(raw)) == {1: [0.0, 10.0, 0.0, 15.0], 2: [0.0]}


def test_unknown_value_without_flow_counts_as_zero(events_of):
    raw = events_of([(1, 0, 4.0, 3, 1), (1, 1, None, 17, 1), (1, 2, 1.0, 2, 1), (1, 3, 1.0, 21, 1)])
    features = features_of(raw, 2.0, 4.0)
    assert balances(features) == {1: [0.0, 4.0, 4.0, 3.0]}
    norm = [r.value_norm for r in features.rows().orderBy("pos").collect()]
    assert norm == [0.5, -0.5, -0.25, -0.25]


def test_seconds_are_truncated(spark):
    raw = spark.sql(
        "select 1L user_id, t timestamp_event, 1D value, 1 event_type, 1L product_id from values "
        "(timestamp_ntz'2024-01-01 00:00:01.9'), (timestamp_ntz'2024-01-01 00:00:03.5') as v(t)"
    )
    assert [r.time_delta for r in features_of(raw).rows().orderBy("pos").collect()] == [0, 1]


def test_missing_products_and_users(events_of):
    raw = events_of([(1, 0, 1.0, 1, None), (None, 0, 1.0, 1, 5)])
    assert [(r.user_id, r.product_id) for r in normalise_events(raw).collect()] == [(1, 0)]


def test_type_overflow_is_an_error(events_of):
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        normalise_events(events_of([(1, 0, 1.0, 300, 1)])).collect()


def brute_force(rows):
    """Position, gap and balance per event id, one user at a time."""
    result = {}
    users = {}
    for i, (user, second, value, kind, _) in enumerate(rows):
        users.setdefault(user, []).append((second, i, value, kind))
    for history in users.values():
        total, known, last = 0.0, False, None
        for pos, (second, i, value, kind) in enumerate(sorted(history, key=lambda h: h[:2])):
            sign = -1 if kind in (2, 4, 21) else 1 if kind in (3, 5, 19) else 0
            flow = None if value is None and sign else sign * (value or 0.0)
            result[i] = (pos, len(history), 0 if last is None else second - last, total if known else 0.0)
            known = flow is not None
            total += flow or 0.0
            last = second
    return result


@pytest.mark.parametrize("max_events", [10**6, 40, 7])
def test_segmented_histories_equal_brute_force(events_of, short_segments, max_events):
    """One user holds most rows, with equal times and missing values; segments change nothing."""
    rng = random.Random(max_events)
    rows = [
        (
            rng.choice([1, 1, 1, 1, 2, 3, 4, 5]),
            rng.randrange(25),
            rng.choice([None, 1.0, 2.5, -3.0]),
            rng.choice([1, 2, 3, 17, 19, 21]),
            rng.randrange(9),
        )
        for _ in range(300)
    ]
    histories = split_histories(normalise_events(events_of(rows)), max_events)
    assert (histories.heavy is None) == (max_events > 300)
    got = {
        r.event_id: (r.pos, r.n_events, r.time_delta, r.balance)
        for r in event_features(histories).rows().collect()
    }
    assert got == brute_force(rows)


def test_a_heavy_user_is_spread_over_segments(events_of, short_segments):
    """A third of all rows at one single moment still becomes several bounded segments."""
    rows = [(1, 0, 1.0, 3, 1)] * 300 + [(u, u % 7, 1.0, 3, 1) for u in range(2, 602)]
    histories = split_histories(normalise_events(events_of(rows)), 50)
    sizes = [r["count"] for r in histories.heavy.groupBy("segment").count().collect()]
    assert sum(sizes) == 300 and len(sizes) >= 5 and max(sizes) <= 100
    assert histories.regular.where(F.col("user_id") == 1).isEmpty()
    top = event_features(histories).rows().where(F.col("user_id") == 1)
    assert sorted(r.balance for r in top.collect()) == [float(i) for i in range(300)]


def test_heavy_users_are_found_on_part_of_the_rows(events_of, monkeypatch):
    monkeypatch.setattr("eventstrand.operators.histories.COUNTED_ROWS", 100)
    rows = [(1, i, 1.0, 3, 1) for i in range(3000)] + [(u, u % 7, 1.0, 3, 1) for u in range(2, 802)]
    histories = split_histories(normalise_events(events_of(rows)), 1000)
    assert {r.user_id for r in histories.heavy.select("user_id").distinct().collect()} == {1}
    features = event_features(histories).rows()
    assert features.count() == 3800
    assert {r.n_events for r in features.where("user_id = 1").collect()} == {3000}


def test_arrival_order_without_event_ids(events_of):
    raw = events_of([(1, 5, float(i), 3, i) for i in range(20)]).drop("event_id")
    assert [r.product_id for r in features_of(raw).rows().orderBy("pos").collect()] == list(range(20))


def test_log_features(events_of):
    raw = events_of([(1, 0, 9.0, 2, 1), (1, 99, 1.0, 1, 1)])
    last = features_of(raw).rows().where("pos = 1").first()
    assert last.time_delta_norm == pytest.approx(math.log(100), rel=1e-6)
    assert last.balance_norm == pytest.approx(math.log(10), rel=1e-6)


def jobs_of(spark, fn):
    group = f"test-{id(fn)}"
    spark.sparkContext.setJobGroup(group, "test")
    try:
        result = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_prepared_histories_are_planned_without_a_job(spark, events_of, tmp_path):
    rng = random.Random(4)
    rows = [(u, rng.randrange(50), rng.random(), rng.choice((1, 2, 3, 21)), 7) for u, n in ((1, 400), (2, 30), (3, 90)) for _ in range(n)]
    raw = events_of(rows).cache()
    path, spec = str(tmp_path / "p"), WindowSpec(12, 5, 100)
    _, n_jobs = jobs_of(spark, lambda: prepare_dataset(raw, path, 40, min_segment=1))
    assert n_jobs > 0
    segments = spark.read.parquet(f"{path}/segments").collect()
    assert {r.user_id for r in segments} == {1, 3} and sum(r.n_events for r in segments) == 490
    per_segment = [sum(r.n_events for r in segments if r.segment == s) for s in {r.segment for r in segments}]
    assert len(per_segment) >= 8 and max(per_segment) <= 120  # as short as asked for, user 1 lies in many
    (features, windows), n_jobs = jobs_of(
        spark, lambda: (features_of(raw, prepared=path).rows(), build_windows(raw, spec, prepared=path))
    )
    assert n_jobs == 0
    plain = features_of(raw).rows()
    key = [c for c in plain.columns if not c.startswith("balance")]
    assert features.select(key).exceptAll(plain.select(key)).isEmpty() and features.count() == plain.count()
    want = build_windows(raw, spec).drop("num_feats_seq")
    got = windows.drop("num_feats_seq")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_short_segments_share_tasks(spark, events_of, tmp_path, monkeypatch):
    """Tasks and files grow with the heavy users' events, not with the number of segments."""
    monkeypatch.setattr("eventstrand.operators.histories.TASK_EVENTS", 1000)
    rows = [(u, i // 3, float(i % 5), 3, 1) for u in range(40) for i in range(50)] + [(99, 0, 1.0, 3, 1)] * 5
    raw = events_of(rows)
    path = prepare_dataset(raw, str(tmp_path / "p"), 10, min_segment=1)
    assert len([f for f in os.listdir(f"{path}/events") if f.endswith(".parquet")]) <= 3
    stored = spark.read.parquet(f"{path}/events")
    segments = stored.groupBy("segment").agg(
        F.count("*").alias("n"), *[f(F.struct("user_id", "timestamp_event", "event_id")).alias(f.__name__) for f in (F.min, F.max)]
    ).orderBy("segment").collect()
    assert sum(r.n for r in segments) == 2000 and len(segments) >= 200 and max(r.n for r in segments) <= 10
    assert all(a.max < b.min for a, b in zip(segments, segments[1:]))
    got, plain = features_of(raw, prepared=path).rows(), features_of(raw).rows()
    assert got.count() == 2005 and got.exceptAll(plain).isEmpty()
    assert split_histories(normalise_events(raw), 10, min_segment=1).heavy.rdd.getNumPartitions() <= 3


def test_preparing_again(spark, events_of, tmp_path):
    raw, path = events_of([(1, i, 1.0, 1, 1) for i in range(20)] + [(2, 0, 1.0, 1, 1)]), str(tmp_path / "p")
    with pytest.raises(ValueError, match="not prepared"):
        features_of(raw, prepared=path)
    prepare_dataset(raw, path, 5, min_segment=1)
    before = sorted(os.listdir(f"{path}/events"))
    prepare_dataset(raw, path, 5, min_segment=1)  # complete: left alone
    assert sorted(os.listdir(f"{path}/events")) == before
    with pytest.raises(ValueError, match="was begun with"):
        prepare_dataset(raw, path, 6, min_segment=1)
    # nobody heavy: all users are ordinary
    other = prepare_dataset(raw, str(tmp_path / "q"), 1000)
    assert features_of(raw, prepared=other).rows().count() == 21
