from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventstrand.adapters import TEST_MEAN, TEST_SPEC, TEST_STD, raw_events
from eventstrand.operators import windows as windows_module
from eventstrand.operators.windows import (
    WindowSpec,
    covering_starts,
    ending_starts,
    history_filter_counts,
    normalise_windows,
    sequence_windows,
    upper_case_names,
    user_history,
)
from eventstrand.plans.preprocess import build_windows, features_of


def expected_starts(n, spec):
    last = max(n - spec.length - 1, 0)
    step = spec.length if n > spec.stride_threshold else spec.stride
    return sorted(set(range(0, last + 1, step)) | {last})[: spec.max_windows]


def test_starts_on_a_grid_of_settings(spark):
    """All history lengths up to 60 under 96 settings, against the rule written per history."""
    specs = [
        WindowSpec(n, s, t, None, m)
        for n, s, t, m in product([2, 5, 8], [1, 2, 5, 9], [20, 1000], [None, 1, 3, 4])
    ]
    events = spark.range(1, 61).select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id") - 1)))
    rows = events.select(
        "id", "col", *[covering_starts(F.col("col"), F.col("id"), s).alias(str(i)) for i, s in enumerate(specs)]
    ).collect()
    for i, spec in enumerate(specs):
        members = {}
        for row in rows:
            for start in row[2 + i]:
                members.setdefault((row[0], start), []).append(row[1])
        want = {
            (n, start): list(range(start, min(start + spec.length, n - 1) + 1))
            for n in range(1, 61)
            for start in expected_starts(n, spec)
        }
        assert {k: sorted(v) for k, v in members.items()} == want, spec


def test_every_event_ends_at_most_one_window():
    """The rule by which a stream of events is cut, on the same grid."""
    specs = [
        WindowSpec(n, s, t, k, m)
        for n, s, t, k, m in product([2, 5, 8], [1, 2, 5, 9], [20, 1000], [None, 30], [None, 1, 3, 4])
    ]
    for spec in specs:
        for n in range(1, 61):
            pos = np.arange(n)
            starts = ending_starts(pos, np.full(n, n), spec)
            got = {int(s): int(p) for p, s in zip(pos, starts) if s >= 0}
            want = expected_starts(n, spec) if n >= (spec.min_events or 0) else []
            assert got == {s: min(s + spec.length, n - 1) for s in want}, (spec, n)


@pytest.mark.parametrize("rows", [1, 3, 7, 10_000])
def test_windows_do_not_depend_on_the_size_of_batches(spark, sf_dir, rows):
    raw = raw_events(spark.read.parquet(f"{sf_dir}/events.parquet")).where("user_id < 20")
    want = [build_windows(raw, spec, max_events=60).persist() for spec in (TEST_SPEC, WindowSpec(7, 3, 80, 50, 4))]
    history = user_history(features_of(raw), 10).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        for spec, windows in zip((TEST_SPEC, WindowSpec(7, 3, 80, 50, 4)), want):
            got = build_windows(raw, spec)
            assert got.count() == windows.count() and got.exceptAll(windows).isEmpty()
        again = user_history(features_of(raw), 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, history)) == sorted(map(str, again))


def test_long_lists_are_cut_in_bounded_batches(spark, sf_dir, monkeypatch):
    raw = raw_events(spark.read.parquet(f"{sf_dir}/events.parquet")).where("user_id < 5")
    want = build_windows(raw, WindowSpec(30, 1)).collect()
    monkeypatch.setattr(windows_module, "_EVENTS_AT_ONCE", 31)
    assert sorted(map(str, build_windows(raw, WindowSpec(30, 1)).collect())) == sorted(map(str, want))


def histories(events_of, lengths):
    return events_of(
        [(u, i, 1.0, 1 + i % 20, 100 + i) for u, n in enumerate(lengths) for i in range(n)]
    )


@pytest.mark.parametrize("max_events", [10**6, 4])
def test_short_histories(events_of, short_segments, max_events):
    spec = WindowSpec(length=5, stride=2)
    rows = build_windows(histories(events_of, [1, 5, 6, 7]), spec, max_events=max_events).collect()
    got = {(r.user_id, r.window_start): (len(r.input_event_seq), len(r.target_event_seq)) for r in rows}
    assert got == {(0, 0): (1, 0), (1, 0): (5, 4), (2, 0): (5, 5), (3, 0): (5, 5), (3, 1): (5, 5)}


def test_schema(events_of):
    types = dict(build_windows(histories(events_of, [3])).dtypes)
    assert types["input_event_seq"] == "array<tinyint>"
    assert types["input_product_seq"] == "array<bigint>"
    assert types["num_feats_seq"] == (
        "array<struct<value_norm:float,time_delta_norm:float,balance_norm:float>>"
    )
    assert types["target_event_seq"] == "array<tinyint>"


def test_upper_case_tables(events_of, tmp_path):
    """Events and windows with upper-case names, without our extra columns, go through unchanged."""
    raw = histories(events_of, [3, 9])
    upper = raw.drop("event_id").toDF("USER_ID", "TIMESTAMP_EVENT", "VALUE", "EVENT_TYPE", "PRODUCT_ID")
    windows = build_windows(upper, WindowSpec(length=4, stride=2))
    assert windows.exceptAll(build_windows(raw, WindowSpec(length=4, stride=2))).isEmpty()
    exported = upper_case_names(windows)
    assert exported.columns[0] == "USER_ID" and "VALUE_NORM" in dict(exported.dtypes)["NUM_FEATS_SEQ"]
    back = normalise_windows(exported)
    assert back.exceptAll(windows.drop("n_events")).isEmpty()
    foreign = normalise_windows(exported.drop("WINDOW_START", "N_EVENTS"))
    assert foreign.columns == back.columns
    assert foreign.select("window_start").distinct().count() == windows.count()


def test_invariants(spark, sf_dir):
    raw = raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    windows = build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD)
    rows = windows.collect()
    for r in rows:
        assert len(r.input_event_seq) == len(r.input_product_seq) == len(r.num_feats_seq) <= TEST_SPEC.length
        assert r.target_event_seq[:-1] == r.input_event_seq[1:]
        assert None not in r.input_event_seq and None not in r.target_event_seq
    reached = {(r.user_id, r.window_start + i) for r in rows for i in range(len(r.target_event_seq) + 1)}
    assert len(reached) == raw.count()
    assert windows.exceptAll(build_windows(raw, TEST_SPEC, TEST_MEAN, TEST_STD)).isEmpty()


@pytest.mark.parametrize("spec", [TEST_SPEC, WindowSpec(7, 3, 80, 50, 4), WindowSpec(200, 100)])
def test_segmented_users_give_the_same_windows(spark, sf_dir, short_segments, spec):
    raw = raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    plain = build_windows(raw, spec, TEST_MEAN, TEST_STD)
    segmented = build_windows(raw, spec, TEST_MEAN, TEST_STD, max_events=60)
    assert plain.exceptAll(segmented).isEmpty() and segmented.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("max_events", [10**6, 20])
def test_history_chunks_hold_every_event_once(events_of, short_segments, max_events):
    features = features_of(histories(events_of, [1, 10, 25]), max_events=max_events)
    rows = user_history(features, 10).orderBy("user_id", "chunk").collect()
    assert [(r.user_id, r.n_events, r.chunk, len(r.event_type), len(r.num_feats)) for r in rows] == [
        (0, 1, 0, 1, 1), (1, 10, 0, 10, 10), (2, 25, 0, 10, 10), (2, 25, 1, 10, 10), (2, 25, 2, 5, 5),
    ]
    assert sum([r.product_id for r in rows if r.user_id == 2], []) == [100 + i for i in range(25)]


def test_minimum_history(events_of):
    raw = histories(events_of, [3, 4, 5, 9])
    windows = build_windows(raw, WindowSpec(length=4, stride=2, min_events=5))
    assert {r.user_id for r in windows.collect()} == {2, 3}
    assert tuple(history_filter_counts(raw, 5).first()) == (2, 2)


def test_one_shuffle_from_events_to_windows(spark, sf_dir, plan_of):
    """Features, history and windows share the exchange and the sort by user; nothing is grouped after it."""
    raw = raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    for rows in (sequence_windows(features_of(raw), TEST_SPEC), user_history(features_of(raw), 10)):
        rows.collect()
        for plan in (plan_of(rows).split("== Initial Plan ==")):
            assert plan.count("Exchange hashpartitioning") == 1
            assert plan.count("Sort [") == 1 and "Aggregate" not in plan and "Generate" not in plan
            assert plan.count("MapInArrow") == 1
        assert "PushedFilters: [IsNotNull(user_id)]" in plan_of(rows)


def test_unused_columns_are_not_read(spark, sf_dir, plan_of):
    raw = raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    gaps = features_of(raw).rows().select("event_id", "time_delta")
    plan = plan_of(gaps)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
