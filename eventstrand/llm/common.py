"""What the operators share: tables, scratch space on the shared folder, words and word hashes."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventstrand.session import configure, session_folder, shared_dir

# A word is a run of characters other than space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1
ROWS_PER_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text, on the JVM; null gives no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


class Scratch:
    """A folder below ``spark.checkpoint.dir`` for tables that must survive lost executors.

    Leaving the block removes the folder; ``hand_over`` writes a table that stays for the caller until the
    application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.name}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: about how many there are at most, if known; then no more files are written than they need.

        ``df`` must not rely on the number of the task that runs it then, nor read much more than it returns.
        """
        return _stored(df, self.path(name), rows)

    def hand_over(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        return _stored(df, f"{session_folder(self.spark)}/{self.name}", rows)


def _stored(df: DataFrame, path: str, rows: int | None) -> DataFrame:
    """Every file costs an executor several processes on a local file system, so small tables get few."""
    if rows is not None:
        # partitions are joined one after the other, so a task holds no more at a time
        df = df.coalesce(max(math.ceil(rows / ROWS_PER_FILE), df.sparkSession.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_kept: dict = {}


def kept_by_worker(key: Hashable, make: Callable[[], object]):
    """What a Python worker makes once and keeps from task to task, until :func:`free_worker`."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def free_worker() -> None:
    """Let go of what this Python worker keeps.

    Workers outlive the stages of a job, so what one operator kept would stay beside the memory of those after
    it.  Functions over a task's batches that keep nothing call this first.
    """
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def seeded(name: str, count: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers."""
    return np.array(
        [xxhash.xxh3_64_intdigest(f"{name}:{i}") | 1 for i in range(count)], dtype=np.uint64
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


_STEP = seeded("gram", 64)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, built from runs of half the size."""
    if len(hashes) < size:
        return np.empty(0, dtype=np.uint64)
    if size == 1:
        return hashes
    left, right = size - size // 2, size // 2
    a, b = grams(hashes, left), grams(hashes, right)
    n = len(hashes) - size + 1
    return mix(a[:n] * _STEP[size % 64] + b[left : left + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
