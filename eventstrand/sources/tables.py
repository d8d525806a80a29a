"""Parquet and JSON sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_parquet_folder(
    spark: SparkSession, path: str | Sequence[str], glob: str = "*.parquet", schema: StructType | str | None = None
) -> DataFrame:
    """All parquet files of a folder, or of several, whose name matches ``glob``."""
    reader = spark.read.option("pathGlobFilter", glob)
    return (reader.schema(schema) if schema is not None else reader).parquet(*([path] if isinstance(path, str) else path))


def read_first_files(spark: SparkSession, path: str, n_files: int, folders: bool = False) -> DataFrame:
    """Quick mode: only the first ``n_files`` files in name order.

    With ``folders`` all files of one folder, as Spark's tasks write them, count as one file.
    """
    if n_files < 1:
        raise ValueError("n_files must be at least 1")
    everything = read_parquet_folder(spark, path)
    files = everything.inputFiles()
    names = {f.rsplit("/", 1)[0] for f in files} if folders else files
    return read_parquet_folder(spark, sorted(names)[:n_files], schema=everything.schema)


def read_split_lists(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{"train": [...], "test": [...]}`` -> one row (user_id, split) per listed user.

    A single JSON document is parsed by one task.  With ``lines`` there are many documents, one per line
    (see :func:`~eventstrand.sources.sinks.write_split_lists`), and many tasks read them.
    """
    lists = spark.read.schema("train array<bigint>, test array<bigint>").json(path, multiLine=not lines)
    labelled = F.array(
        *[F.struct(F.lit(s).alias("split"), F.col(s).alias("users")) for s in ("train", "test")]
    )
    return lists.select(F.explode(labelled).alias("s")).select(
        F.explode("s.users").alias("user_id"), F.col("s.split").alias("split")
    )


def read_split_rows(spark: SparkSession, path: str) -> DataFrame:
    """Splittable form of the same list: one ``{"user_id": .., "split": ..}`` object per line."""
    return spark.read.schema("user_id bigint, split string").json(path)


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical union by column name."""
    return reduce(lambda left, right: left.unionByName(right), frames)
