"""User lists, train/validation splits by user and by output bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def distinct_users(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct()


def keep_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the listed users; cheapest on events, before windows several times their size are made.

    No broadcast hint: a user list grows with the data, so the planner decides by its size, and a hot
    user in a sort-merge semi join is split by the adaptive skew rule.
    """
    return df.join(users.select("user_id"), "user_id", "left_semi")


def split_row_counts(windows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows per split in one pass; rows are counted per user before the join, so no user is hot."""
    per_user = windows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(split, "user_id").groupBy("split").agg(F.sum("n").alias("n_rows"))


def _last_train_bucket(df: DataFrame, bucket: str, train_fraction: float) -> DataFrame:
    """One row: the last bucket of the train side.

    A bucket stands for one output file group; their number is a setting of the writer, so the
    unpartitioned windows below are over that few rows.
    """
    ranked = df.select(bucket).distinct().select(
        bucket,
        F.row_number().over(Window.orderBy(bucket)).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_buckets"),
    )
    train = F.col("rank") <= F.floor(F.col("n_buckets") * F.lit(train_fraction))
    too_few = F.raise_error(F.lit("a split needs at least 2 buckets"))
    return ranked.agg(
        F.when(F.max("n_buckets") < 2, too_few).otherwise(F.max(F.when(train, F.col(bucket)))).alias("last")
    )


def with_bucket_side(df: DataFrame, bucket: str = "bucket", train_fraction: float = 0.8) -> DataFrame:
    """Add ``side``: train for the first ``train_fraction`` of the buckets in order, val for the rest.

    The border is a scalar subquery, so no row is shuffled or joined to learn its side.
    """
    border = _last_train_bucket(df, bucket, train_fraction).scalar()
    in_train = F.coalesce(F.col(bucket) <= border, F.lit(False))
    return df.withColumn("side", F.when(in_train, F.lit("train")).otherwise(F.lit("val")))


def bucket_split(df: DataFrame, bucket: str = "bucket", train_fraction: float = 0.8) -> DataFrame:
    """(bucket, side) of every bucket."""
    return with_bucket_side(df.select(bucket).distinct(), bucket, train_fraction)


def train_val_rows(
    windows: DataFrame, split: DataFrame | None = None, bucket: str = "bucket", train_fraction: float = 0.8
) -> DataFrame:
    """Effective sets: train buckets with train users, val buckets with test users; the rest unused.

    Windows that carry a ``split`` column, from events it was attached to, are filtered where they are.
    Otherwise whole windows are joined with ``split`` (user_id, split) for it.
    """
    sides = with_bucket_side(windows, bucket, train_fraction)
    if "split" not in windows.columns:
        sides = sides.join(split, "user_id")
    wanted = F.when(F.col("side") == "train", F.lit("train")).otherwise(F.lit("test"))
    return sides.where(F.col("split") == wanted).drop("split")
