"""Tables stored by user: files bucketed on the user, so that joins and groupings by user find their rows in place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from eventstrand.session import remove_folder


def write_by_user(df: DataFrame, table: str, path: str, n_buckets: int, *order: str) -> DataFrame:
    """Store ``df`` at ``path`` as the catalogue's ``table``, hashed by ``user_id`` into ``n_buckets``; returns the table.

    A bucket is one file: rows are brought together first, sorted by the user and ``order`` inside.  Tables of
    one number of buckets that are joined or grouped by the user need no exchange, whatever their sizes; a
    user with more rows than a task should read wants :func:`split_histories` instead.
    """
    (
        df.repartition(n_buckets, "user_id").write.mode("overwrite").format("parquet").option("compression", "zstd")
        .bucketBy(n_buckets, "user_id").sortBy("user_id", *order).option("path", path).saveAsTable(table)
    )
    return df.sparkSession.table(table)


def open_by_user(spark: SparkSession, table: str, path: str, schema: str, n_buckets: int, *order: str) -> DataFrame:
    """Enter a folder that :func:`write_by_user` left into the catalogue of another session, as it was written."""
    sorted_by = ", ".join(("user_id", *order))
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet LOCATION '{path}' "
        f"CLUSTERED BY (user_id) SORTED BY ({sorted_by}) INTO {n_buckets} BUCKETS"
    )
    return spark.table(table)


@contextmanager
def tables_by_user(spark: SparkSession, folder: str, n_buckets: int) -> Iterator:
    """A function ``store(df, name, *order)`` for tables that go, with their files, at the end of the block."""
    names = []

    def store(df: DataFrame, name: str, *order: str) -> DataFrame:
        names.append(f"{name}_{uuid.uuid4().hex}")
        return write_by_user(df, names[-1], f"{folder}/{name}", n_buckets, *order)

    try:
        yield store
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(spark, folder)
