"""The given test tables seen through the schemas of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventstrand.functions.hashing import md5_below, md5_uniform
from eventstrand.operators.features import normalise_events
from eventstrand.operators.windows import WindowSpec

# Codes given to the event names of the test table.
EVENT_CODES = {"view": 1, "purchase": 2, "signup": 3, "click": 17, "error": 21}

# Small windows for small histories (45 to 99 events per user).
TEST_SPEC = WindowSpec(length=20, stride=10, stride_threshold=70)
TEST_MIN_EVENTS = 60
TEST_MAX_WINDOWS = 3
TEST_MEAN, TEST_STD = 50.0, 50.0


def raw_events(events: DataFrame) -> DataFrame:
    """Table ``events`` as raw user events; the value is missing where k is a multiple of 7."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    code = F.lit(None)
    for name, number in EVENT_CODES.items():
        code = F.when(F.col("event_type") == name, F.lit(number)).otherwise(code)
    return events.select(
        "user_id",
        F.col("ts").alias("timestamp_event"),
        "event_id",
        F.when(k % 7 != 0, F.col("value")).alias("value"),
        code.alias("event_type"),
        k.alias("product_id"),
    )


def events_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Table ``lineitem`` as the event history of each supplier (hundreds of events per user)."""
    return normalise_events(
        lineitem.select(
            F.col("l_suppkey").alias("user_id"),
            F.col("l_shipdate").alias("timestamp_event"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
            F.col("l_quantity").alias("value"),
            F.col("l_linenumber").alias("event_type"),
            F.col("l_partkey").alias("product_id"),
        )
    )


def hash_split(users: DataFrame, train_fraction: float = 0.8) -> DataFrame:
    """(user_id, split) by the md5 of the user id."""
    in_train = md5_uniform(F.col("user_id")) < train_fraction
    return users.select(
        "user_id", F.when(in_train, F.lit("train")).otherwise(F.lit("test")).alias("split")
    )


def window_embeddings(embeddings: DataFrame) -> DataFrame:
    """Table ``embeddings`` as window embeddings, five windows per user."""
    return embeddings.select(
        F.call_function("div", F.col("vec_id"), F.lit(5)).alias("user_id"),
        (F.col("vec_id") % 5).alias("window_start"),
        "embedding",
    )


def masked_view(vector: Column, probability: float, *key) -> Column:
    """Second view of a vector: coordinates zeroed at random, seeded by ``key`` and coordinate."""
    return F.transform(
        vector,
        lambda x, i: F.when(md5_below(probability, *key, i), F.lit(0.0).cast("float")).otherwise(x),
    )
