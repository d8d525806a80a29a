"""Global row numbers, seeded order and samples without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from eventstrand.functions.hashing import md5_hex
from eventstrand.functions.sequences import int_div
from eventstrand.session import materialise

# monotonically_increasing_id() puts the partition number above this bit.
_PARTITION_SHIFT = 33


def global_row_number(df: DataFrame, order: Sequence[str], output: str) -> DataFrame:
    """1-based row number in the order of unique columns.

    Range partitioning sorts in parallel; a row's number is its place in its partition plus the sizes
    of the partitions before it.  The ranged rows are checkpointed, so both reads see the same ones.
    """
    ranged = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftright("__place", _PARTITION_SHIFT)
    by_part = Window.orderBy("__part")  # one row per partition
    offsets = (
        ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
        .select(
            "__part",
            F.coalesce(
                F.sum("__rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("__offset"),
        )
    )
    place_in_part = F.col("__place") - F.shiftleft("__part", _PARTITION_SHIFT)
    return (
        ranged.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(output, place_in_part + F.col("__offset") + 1)
        .drop("__place", "__part", "__offset")
    )


def _with_hash(df: DataFrame, key: Sequence[str], seed: int, prefix_digits: int) -> DataFrame:
    """Add the md5 of (seed, key) and its first digits, which group the rows evenly."""
    return df.withColumn("__hash", md5_hex(seed, *[F.col(k) for k in key])).withColumn(
        "__prefix", F.substring("__hash", 1, prefix_digits)
    )


def _rows_before(hashed: DataFrame) -> DataFrame:
    """Per prefix: its rows and the rows with smaller prefixes; at most 16 ** digits rows."""
    earlier = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("__prefix").agg(F.count(F.lit(1)).alias("__rows"))
    return counts.withColumn("__offset", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))


def seeded_batches(
    df: DataFrame, key: Sequence[str], batch_size: int, seed: int, prefix_digits: int = 4
) -> DataFrame:
    """Shuffled order and batch number: rows ordered by md5 of (seed, key), ``batch_size`` per batch.

    Rows are ranked inside their hash prefix (``key`` must be unique, so prefixes are even) and moved
    up by the rows of the prefixes before; nothing is sorted globally.  Four digits give at most 65,536
    tasks; more rows than those tasks can rank want more digits.
    """
    hashed = _with_hash(df, key, seed, prefix_digits)
    inside = Window.partitionBy("__prefix").orderBy("__hash", *key)
    offsets = F.broadcast(_rows_before(hashed).drop("__rows"))
    return (
        hashed.withColumn("__place", F.row_number().over(inside))
        .join(offsets, "__prefix")
        .withColumn("shuffled_position", F.col("__offset") + F.col("__place") - 1)
        .withColumn("batch_id", int_div(F.col("shuffled_position"), F.lit(batch_size)))
        .drop("__hash", "__prefix", "__place", "__offset")
    )


def seeded_sample(
    df: DataFrame, key: Sequence[str], size: int, seed: int, prefix_digits: int = 4
) -> DataFrame:
    """Random sample without replacement of min(n, size) rows: the smallest seeded hashes.

    Rows above the prefix that holds the last sampled row are dropped where they are read, so only
    little more than ``size`` rows reach the final sort.
    """
    hashed = _with_hash(df, key, seed, prefix_digits)
    last = _rows_before(hashed).agg(
        F.min(F.when(F.col("__offset") + F.col("__rows") >= size, F.col("__prefix"))).alias("last")
    )
    beyond = F.coalesce(F.col("__prefix") > last.scalar(), F.lit(False))
    return hashed.where(~beyond).orderBy("__hash", *key).limit(size).drop("__hash", "__prefix")
