"""User histories that are safe to order and accumulate, whatever their size.

A window partition is one task, so a user holding a third of all events would stall the job.
Users up to ``max_events`` go through plain per-user windows.  The events of heavier users are
range-partitioned by (user, time, event id), and each partition is cut into segments of at most
``max_events`` rows; a segment is ordered on its own and receives a small carry row summarising the
user's earlier segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from eventstrand.functions.sequences import int_div
from eventstrand.session import check_manifest, folder_exists, materialise

MAX_EVENTS_PER_TASK = 5_000_000
MAX_BROADCAST_USERS = 1_000_000
COUNTED_ROWS = 10_000
MIN_SEGMENT_EVENTS = 1_000  # shorter segments cost more than they spread
TASK_EVENTS = 100_000  # that a task cuts into segments, if those are shorter

ORDER = ("timestamp_event", "event_id")


@dataclass(frozen=True)
class Histories:
    """Events of ordinary users, and of heavy users cut into segments (None if there are none)."""

    regular: DataFrame
    heavy: DataFrame | None = None

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Histories":
        return Histories(fn(self.regular), None if self.heavy is None else fn(self.heavy))

    def rows(self) -> DataFrame:
        """All rows as one DataFrame, without the segment number."""
        if self.heavy is None:
            return self.regular
        return self.regular.unionByName(self.heavy.drop("segment"))


def user_keys(df: DataFrame) -> list[str]:
    """What a user is grouped by: an output bucket and its part, a split, if the events carry them, and the id.

    All are functions of the user.  Grouping by them too lets events that are already partitioned by
    bucket and part stay where they are, and hands the split on to the windows.
    """
    return [c for c in ("bucket", "part", "split", "user_id") if c in df.columns]


def _heavy_users(events: DataFrame, max_events: int) -> DataFrame:
    """(user_id, n): users above ``max_events``, counted on just enough rows to see that as about ``COUNTED_ROWS``.

    Both ways give the same results, so who is heavy may be estimated.  That keeps the count from
    shuffling (user, count) rows for nearly every event.
    """
    fraction = min(1.0, COUNTED_ROWS / max_events)
    counted = events if fraction == 1.0 else events.sample(fraction, seed=0)
    counts = counted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_events * fraction)
    return counts.withColumn("n", F.ceil(F.col("n") / fraction))


def _segments(events: DataFrame, heavy_users: DataFrame, n_rows: int, max_events: int, min_segment: int | None) -> DataFrame:
    """The events of the heavy users with ``segment``, ranges of (user, time, event id) of ``max_events`` rows at most.

    A partition holds many segments if they are short, so tasks and files grow with the events only.  Rows
    come in order, and so do the numbers of segments.  They are fixed once the rows are stored.
    """
    length = max(max_events, MIN_SEGMENT_EVENTS if min_segment is None else min_segment)
    n_tasks = math.ceil(n_rows / max(length, TASK_EVENTS)) + 1
    number = F.monotonically_increasing_id()  # the partition above the lower 33 bits, the row in it below
    row = number.bitwiseAND(F.lit((1 << 33) - 1))
    return (
        events.join(heavy_users.select("user_id"), "user_id", "left_semi")
        .repartitionByRange(n_tasks, "user_id", *ORDER)
        .sortWithinPartitions("user_id", *ORDER)
        .withColumn("segment", number - row + int_div(row, F.lit(length)))
    )


def split_histories(events: DataFrame, max_events: int = MAX_EVENTS_PER_TASK, min_segment: int | None = None) -> Histories:
    """Separate the users whose history is too long for one task and cut it into segments.

    Segments have up to ``max_events`` events, or ``min_segment`` if that is more (``MIN_SEGMENT_EVENTS`` by default).
    Users are counted, and heavy ones are partitioned and checkpointed, while the plan is made; a dataset
    that is read more than once is prepared by :func:`prepare_histories`.
    """
    heavy_users = _heavy_users(events, max_events)
    n_users, n_rows = heavy_users.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_users == 0:
        return Histories(events)
    heavy_users = materialise(heavy_users)
    if n_users <= MAX_BROADCAST_USERS:
        heavy_users = F.broadcast(heavy_users)
    return Histories(
        regular=events.join(heavy_users.select("user_id"), "user_id", "left_anti"),
        heavy=materialise(_segments(events, heavy_users, n_rows, max_events, min_segment)),
    )


def prepare_histories(
    events: DataFrame, path: str, max_events: int = MAX_EVENTS_PER_TASK, min_segment: int | None = None
) -> None:
    """Store, once per dataset, who is heavy and their events in segments, for :func:`open_histories`.

    Leaves ``path/users`` (user_id, n), ``path/events`` with ``segment`` in order inside a segment, and
    ``path/segments`` (segment, user_id, n_events, first and last time), the borders.  A folder that is
    complete is left alone; another ``max_events`` than it was made with is refused.
    """
    spark = events.sparkSession
    check_manifest(spark, f"{path}/settings", {"max_events": max_events, "min_segment": min_segment})
    if folder_exists(spark, f"{path}/segments/_SUCCESS"):
        return
    _heavy_users(events, max_events).write.mode("overwrite").parquet(f"{path}/users")
    users = spark.read.schema("user_id bigint, n bigint").parquet(f"{path}/users")
    n_rows = users.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = _segments(events, users, n_rows, max_events, min_segment)
    cut.write.mode("overwrite").parquet(f"{path}/events")
    stored = spark.read.schema(cut.schema).parquet(f"{path}/events")
    borders = stored.groupBy("segment", "user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("timestamp_event").alias("first_ts"), F.max("timestamp_event").alias("last_ts")
    )
    borders.write.mode("overwrite").parquet(f"{path}/segments")


def open_histories(events: DataFrame, path: str) -> Histories:
    """The histories of events that :func:`prepare_histories` was given before; no job runs to plan them.

    ``events`` must be those rows: ordinary users are read from them in one scan, heavy ones from the
    segments of the folder.
    """
    spark = events.sparkSession
    if not folder_exists(spark, f"{path}/segments/_SUCCESS"):
        raise ValueError(f"{path} is not prepared")
    users = spark.read.schema("user_id bigint").parquet(f"{path}/users")
    schema = StructType(events.schema.fields).add("segment", "long")
    return Histories(
        regular=events.join(users, "user_id", "left_anti"), heavy=spark.read.schema(schema).parquet(f"{path}/events")
    )


def segment_carry(heavy: DataFrame) -> DataFrame:
    """Per (user, segment): the length of the history and what its earlier segments add up to.

    One row per segment a user touches, so the window below never sees more rows than segments.
    """
    of_user = Window.partitionBy("user_id")
    by_segment = of_user.orderBy("segment")
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    return (
        heavy.groupBy("user_id", "segment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("net_cashflow").alias("flow"),
            F.max("timestamp_event").alias("last_ts"),
            F.max_by("net_cashflow", F.struct(*ORDER)).alias("last_flow"),
        )
        .select(
            "user_id",
            "segment",
            F.sum("n").over(of_user).alias("n_events"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carry_pos"),
            F.coalesce(F.sum("flow").over(earlier), F.lit(0.0)).alias("carry_flow"),
            F.lag("last_ts").over(by_segment).alias("carry_ts"),
            F.lag("last_flow").over(by_segment).alias("carry_last_flow"),
        )
    )
