"""Tables stored by user: what is joined, grouped or ordered by the user is not shuffled."""

from __future__ import annotations

import os

import pytest

from eventstrand.adapters import TEST_SPEC, hash_split, raw_events
from eventstrand.catalog import queries
from eventstrand.operators.splits import distinct_users, keep_users
from eventstrand.plans.preprocess import build_windows
from eventstrand.sources.bucketed import open_by_user, tables_by_user, write_by_user


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return raw_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plans_without_an_exchange(spark, raw, tmp_path, plan_of, no_broadcast):
    with tables_by_user(spark, str(tmp_path / "t"), 6) as store:
        events = store(raw, "events", "timestamp_event", "event_id")
        split = store(hash_split(distinct_users(raw)), "split")
        joined = keep_users(events, split.where("split = 'train'"))
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        for build in (queries._stored_semi_join, queries._stored_train_val):
            plan = plan_of(build(events, split))
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            # the border between train and validation buckets is a subquery over a handful of bucket numbers
            assert "Exchange" not in plan.split("Subquery")[0] and "hashpartitioning(user_id" not in plan
        # the same on plain files needs both sides by user
        plain = plan_of(keep_users(raw, hash_split(distinct_users(raw)).where("split = 'train'")))
        assert plain.count("Exchange hashpartitioning(user_id") >= 2
        assert joined.count() == keep_users(raw, hash_split(distinct_users(raw)).where("split = 'train'")).count()
    assert not os.path.exists(tmp_path / "t") and not [t for t in spark.catalog.listTables() if t.name.startswith("events_")]


def test_a_stored_table_is_found_by_its_folder(spark, raw, tmp_path, plan_of, no_broadcast):
    path = str(tmp_path / "events")
    stored = write_by_user(raw, "by_user_first", path, 4, "timestamp_event")
    schema = ", ".join(f"{name} {kind}" for name, kind in stored.dtypes)
    spark.sql("DROP TABLE by_user_first")
    assert os.listdir(path)  # the files are not the catalogue's
    again = open_by_user(spark, "by_user_again", path, schema, 4, "timestamp_event")
    try:
        assert again.exceptAll(raw).isEmpty() and again.count() == raw.count()
        assert len(again.inputFiles()) == 4
        windows = build_windows(again, TEST_SPEC)
        assert "Exchange" not in plan_of(windows)
        assert windows.exceptAll(build_windows(raw, TEST_SPEC)).isEmpty()
    finally:
        spark.sql("DROP TABLE by_user_again")
