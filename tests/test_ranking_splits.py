import hashlib

import pytest
from pyspark.sql import functions as F

from eventstrand.functions.hashing import md5_below, md5_uniform
from eventstrand.operators.ranking import global_row_number, seeded_batches, seeded_sample
from eventstrand.operators.splits import bucket_split, keep_users, split_row_counts, train_val_rows


def test_global_row_number(spark):
    ids = spark.range(5000).select((F.col("id") * 7919 % 5003 - 2000).alias("x")).repartition(6)
    rows = sorted(tuple(r) for r in global_row_number(ids, ["x"], "n").select("x", "n").collect())
    assert [n for _, n in rows] == list(range(1, 5001))


def test_seeded_batches_are_full_shuffled_and_repeatable(spark):
    keys = spark.range(1003).withColumn("half", F.col("id") % 2)
    got = seeded_batches(keys, ["id"], 100, seed=3)
    rows = {r.id: (r.shuffled_position, r.batch_id) for r in got.collect()}
    want = sorted(range(1003), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    assert rows == {i: (place, place // 100) for place, i in enumerate(want)}
    again = seeded_batches(keys.repartition(5), ["id"], 100, seed=3, prefix_digits=1)
    assert rows == {r.id: (r.shuffled_position, r.batch_id) for r in again.collect()}


@pytest.mark.parametrize("size", [0, 1, 37, 500, 900])
def test_seeded_sample_takes_the_smallest_hashes(spark, size):
    got = {r.id for r in seeded_sample(spark.range(500), ["id"], size, seed=1).collect()}
    want = sorted(range(500), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())[:size]
    assert got == set(want)


@pytest.mark.parametrize("p", [0.0, 1e-12, 0.15, 0.5, 1.0])
def test_text_comparison_equals_the_number(spark, p):
    rows = spark.range(2000).select(
        md5_below(p, 9, F.col("id")).alias("a"), (md5_uniform(9, F.col("id")) < p).alias("b")
    )
    assert rows.where("a <> b").isEmpty()


def windows(spark):
    return spark.range(40).selectExpr("id % 8 user_id", "id div 8 window_start", "id % 8 % 4 bucket")


SPLIT = [(0, "train"), (1, "train"), (2, "train"), (3, "test"), (7, "test"), (99, "train")]


def test_bucket_split(spark):
    sides = {r.bucket: r.side for r in bucket_split(windows(spark), train_fraction=0.8).collect()}
    assert sides == {0: "train", 1: "train", 2: "train", 3: "val"}
    with pytest.raises(Exception, match="at least 2 buckets"):
        bucket_split(windows(spark).where("bucket = 1")).collect()


def test_effective_train_and_val_rows(spark):
    split = spark.createDataFrame(SPLIT, "user_id bigint, split string")
    rows = train_val_rows(windows(spark), split)
    assert {(r.user_id, r.side) for r in rows.collect()} == {
        (0, "train"), (1, "train"), (2, "train"), (3, "val"), (7, "val")
    }
    counts = {r.split: r.n_rows for r in split_row_counts(windows(spark), split).collect()}
    assert counts == {"train": 15, "test": 10}
    train = split.where("split = 'train'")
    assert keep_users(windows(spark), train).count() == 15


def test_sides_need_no_join(spark, plan_of):
    split = spark.createDataFrame(SPLIT, "user_id bigint, split string")
    plan = plan_of(train_val_rows(windows(spark), split))
    main = plan.split("Subquery")[0]
    assert main.count("Join") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
