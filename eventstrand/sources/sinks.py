"""Parquet sinks: bucketed windows, resumable writing, reports."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventstrand.functions.hashing import md5_int
from eventstrand.session import check_manifest, folder_exists, remove_folder

logger = logging.getLogger(__name__)

PARTS_PER_BUCKET = 16
USERS_PER_DOCUMENT = 100_000


def bucket_of(user_id: Column, n_buckets: int, seed: int = 0) -> Column:
    """Output bucket of a user: the same in every run."""
    return F.pmod(md5_int(seed, user_id), F.lit(n_buckets)).cast("int")


def with_bucket(df: DataFrame, n_buckets: int, seed: int = 0) -> DataFrame:
    return df.withColumn("bucket", bucket_of(F.col("user_id"), n_buckets, seed))


def gather_buckets(bucketed: DataFrame) -> DataFrame:
    """Bring the rows of a bucket into few tasks; a bucket too large for one task is split."""
    return bucketed.hint("rebalance", "bucket")


def with_part(bucketed: DataFrame, parts: int) -> DataFrame:
    """Add ``part``: users of one bucket in ``parts`` hash groups, so that a bucket is several tasks and files."""
    return bucketed.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int"))


def write_buckets(bucketed: DataFrame, path: str) -> None:
    """Zstd parquet, one folder per bucket (and split, if there is one); only the buckets present are replaced.

    Each task writes a file per bucket it holds: rows should be gathered by bucket before.
    """
    folders = [c for c in ("bucket", "split") if c in bucketed.columns]
    (
        bucketed.drop("part").write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


class IncompleteDataset(RuntimeError):
    """Some buckets failed; they stay pending and the next run tries them again."""


def fingerprint(bucketed: DataFrame) -> DataFrame:
    """(bucket, n_rows, row_hash): what is in each bucket, whatever the order, files and partitions of the rows.

    ``row_hash`` adds up a hash of all columns by name, nulls told apart, so a changed, missing, doubled or moved row
    shows.  One scan, reduced to one row per bucket and task before anything is shuffled.
    """
    columns = sorted((c for c in bucketed.columns if c not in ("bucket", "part")), key=str.lower)
    values = [F.col(f"`{c}`") for c in columns]
    row = F.xxhash64(F.array(*[v.isNull() for v in values]), *values).cast("decimal(38,0)")
    return bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("row_hash"))


def check_input(bucketed: DataFrame, path: str, markers: str) -> None:
    """Record the fingerprint of the rows a dataset is made from, or refuse to go on with other rows.

    Buckets that are marked done without a recorded fingerprint are refused too: nobody knows what they hold.
    """
    spark = bucketed.sparkSession
    now = fingerprint(bucketed)
    if not folder_exists(spark, f"{path}/_SUCCESS"):
        if not done_buckets(spark, markers).isEmpty():
            raise ValueError(f"buckets are marked done at {markers}, but {path} does not say from which rows")
        now.coalesce(1).write.mode("overwrite").parquet(path)
        return
    # one row per bucket on either side
    before = spark.read.schema(now.schema).parquet(path)
    names = ("n_rows", "row_hash")
    both = now.join(before.select("bucket", *[F.col(c).alias(f"old_{c}") for c in names]), "bucket", "full")
    same = F.col("n_rows").eqNullSafe(F.col("old_n_rows")) & F.col("row_hash").eqNullSafe(F.col("old_row_hash"))
    other = sorted(r.bucket for r in both.where(~same).select("bucket").collect())
    if other:
        shown = ", ".join(map(str, other[:10]))
        raise ValueError(f"the rows of {len(other)} buckets ({shown}) are not those the dataset was begun with")


def done_buckets(spark: SparkSession, markers: str) -> DataFrame:
    """Buckets recorded as finished; none before the first run."""
    try:
        return spark.read.schema("bucket int").json(markers).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "bucket int")


def pending_buckets(spark: SparkSession, markers: str, n_buckets: int) -> DataFrame:
    every = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(done_buckets(spark, markers), "bucket", "left_anti")


def write_resumable(
    events: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    markers: str,
    n_buckets: int,
    buckets_per_job: int | None = None,
    seed: int = 0,
    parts: int = PARTS_PER_BUCKET,
    settings: dict | None = None,
) -> list[int]:
    """Build and write the buckets that are not marked done; returns the buckets written now.

    ``build`` maps events with ``bucket`` and ``part`` columns to output rows with them, gathered by
    both.  A resumed run must have the same ``n_buckets``, ``seed`` and ``settings`` as the first, and the
    same events in every bucket, also in those that are done: both are recorded and checked.  With
    several jobs the events are staged once by bucket beside ``markers``, and each job reads its own
    folders only.  A failed group of buckets stays unmarked; the others are still tried, then
    :class:`IncompleteDataset` is raised from the first failure.  The next run overwrites leftovers.
    """
    spark = events.sparkSession
    check_manifest(spark, f"{markers}-manifest", {"n_buckets": n_buckets, "seed": seed, **(settings or {})})
    check_input(with_bucket(events, n_buckets, seed), f"{markers}-input", markers)
    todo = sorted(row.bucket for row in pending_buckets(spark, markers, n_buckets).collect())
    size = buckets_per_job or max(len(todo), 1)
    groups = [todo[i : i + size] for i in range(0, len(todo), size)]
    bucketed = with_part(with_bucket(events, n_buckets, seed), parts)
    staged = f"{markers}-staged"
    if len(groups) > 1:
        wanted = bucketed.where(F.col("bucket").isin(todo)).repartition("bucket", "part")
        write_buckets(wanted, staged)
        bucketed = with_part(spark.read.parquet(staged), parts)
    failed: list[int] = []
    first_error: Exception | None = None
    for group in groups:
        # literal bucket numbers prune the staged folders
        part = bucketed if len(group) == n_buckets else bucketed.where(F.col("bucket").isin(group))
        try:
            write_buckets(build(part), path)
            spark.createDataFrame([(b,) for b in group], "bucket int").coalesce(1).write.mode("append").json(markers)
        except Exception as error:
            logger.exception("buckets %s failed and stay pending", group)
            first_error = first_error or error
            failed += group
    if len(groups) > 1:
        remove_folder(spark, staged)
    if failed:
        raise IncompleteDataset(f"buckets {failed} failed and stay pending") from first_error
    return todo


def write_split_lists(split: DataFrame, path: str) -> None:
    """JSON documents ``{"train": [...], "test": [...]}``, one per line, each of a hash bucket of users.

    A document has about ``USERS_PER_DOCUMENT`` users, so no row or task grows with their number.
    """
    n_documents = -(-split.count() // USERS_PER_DOCUMENT) or 1
    document = F.pmod(F.xxhash64("user_id"), F.lit(n_documents)).alias("document")
    lists = split.groupBy(document).agg(
        *[F.collect_list(F.when(F.col("split") == s, F.col("user_id"))).alias(s) for s in ("train", "test")]
    )
    lists.drop("document").write.json(path)


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Small report table as one file."""
    writer = report.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
