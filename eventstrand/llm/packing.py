"""Best-fit packing of token pieces into fixed-length sequences by hierarchical residual rounds."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eventstrand.llm.common import Scratch
from eventstrand.llm.tokens import by_bytes, encoder

ITEMS_PER_TASK = 50_000
FULL_SHARE = 0.995
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = "item long, bin long, offset long, fill long"


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n_tokens, capacity))]


def pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut what is longer than ``capacity``."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = iter(batch.column(0).to_pylist()), []
            for texts in by_bytes(batch.column(1)):
                for data in ids_of(texts.to_pylist()):
                    doc_id = next(ids)
                    data += end
                    for k, (start, n) in enumerate(cut(len(data) // 4, capacity)):
                        rows.append((doc_id, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch(columns, names=list(names))

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECE_SCHEMA)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin.

    ``open`` lists the rooms that occur among the bins, in order; each room has a stack of its bins.
    """
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    rooms: dict[int, list[int]] = {}
    ordered: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect.bisect_left(ordered, size)
        if at < len(ordered):
            room = ordered[at]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], ordered[at]
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            if left not in rooms:
                rooms[left] = []
                bisect.insort(ordered, left)
            rooms[left].append(b)
    return bins, offsets, fills


def _round(items: DataFrame, level: int, tasks: int, capacity: int) -> DataFrame:
    """Pack ``item, size`` inside each of ``tasks`` hash partitions."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(
            (i, s) for b in batches for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        )
        bins, offsets, fills = best_fit([s for _, s in found], capacity)
        base = (level + 1 << 56) + (TaskContext.get().partitionId() << 28)
        columns = [[i for i, _ in found], [base + b for b in bins], offsets, [fills[b] for b in bins]]
        yield pa.record_batch(
            [pa.array(c, pa.int64()) for c in columns], names=["item", "bin", "offset", "fill"]
        )

    return items.select("item", "size").repartition(tasks, F.xxhash64("item", F.lit(level))).mapInArrow(fit, PLACED_SCHEMA)


def pack(items: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Place ``item, size`` (distinct items, size at most ``capacity``): ``item, sequence_id, offset``.

    Each round packs best-fit inside bounded partitions.  Bins filled to ``FULL_SHARE`` are final; the
    others become items of the next round, which has an eighth of the partitions.  Rounds end after one
    with a single partition, or when a round joins hardly any bins.  Every round is a stored table, so a
    lost executor repeats one task.
    """
    levels, level = [], 0
    n = items.count()
    tasks = -(-n // ITEMS_PER_TASK) or 1
    while True:
        placed = scratch.keep(_round(items, level, tasks, capacity), f"round-{level}")
        levels.append(placed)
        if tasks == 1 or level == 40:
            break
        underfull = (
            placed.where(F.col("fill") < FULL_SHARE * capacity)
            .groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("size"))
        )
        items = scratch.keep(underfull, f"underfull-{level}", n)
        left = items.count()
        if not left:
            break
        tasks = max(-(-left // ITEMS_PER_TASK), -(-tasks // 8)) if left < 0.98 * n else 1
        if left > 4 * ITEMS_PER_TASK * tasks:
            break  # hardly any bins were joined and the rest is too much for one task
        n, level = left, level + 1
    result = levels[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for placed in levels[1:]:
        moved = placed.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("shift"))
        result = result.join(moved, "sequence_id", "left").select(
            "item",
            F.coalesce("bin", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return result


def pack_documents(df: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    ``df`` needs ``doc_id`` and ``text``, other columns are ignored.  A null or empty text is one piece that
    holds the end id.  Rows that share an id are packed as separate documents.  An empty table gives no
    rows.  ``sequence_id`` is any number, ``offset`` the piece's place in its sequence, without gaps.
    """
    with Scratch(df.sparkSession, "packing") as scratch:
        cut_up = scratch.keep(
            pieces(df, vocabulary, end_id, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces"
        )
        short = cut_up.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
        placed = pack(short, capacity, scratch)
        full = cut_up.where(F.col("length") == capacity).select(
            "item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
        return scratch.hand_over(cut_up.join(placed.unionByName(full), "item").drop("item"), cut_up.count())
