"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, seeded block selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eventstrand.llm.common import WORD, Scratch

BLOCK_WORDS = 64
DOCS_PER_SHARD = 10_000
MAX_REPEATS = 3


def targets(sources: DataFrame, weights: Sequence[int], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to one row per ``source`` with its ``source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes.
    ``level * weight`` is every source's target, cut at ``max_repeats`` sizes; resharing the excess by weight
    until none is above ends at the one level that uses up the sum.  Sources sorted by the level at which
    they are cut give it directly.  One row per source, so the windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap = max_repeats * F.col("source_size")
    rated = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn(
        "cut_at", cap / F.col("weight")
    )
    order = Window.orderBy("cut_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    # the level if exactly the sources before this one are cut
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    found = rated.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("cut_at"), F.struct("cut_at", "level"))).over(all_rows)["level"]
    )
    share = F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))
    return found.withColumn("target", F.least(share, cap.cast("double"))).drop("weight", "cut_at", "level")


def _won(weights: np.ndarray, room: np.ndarray, turn: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each key: the highest weight / (2n - 1) with n up to the key's room, ties by ``turn``."""
    room = np.where(weights > 0, room, 0.0)
    if seats >= room.sum():
        return room.astype(np.int64)
    count = lambda level: np.minimum(np.floor(level * weights + 0.5), room)
    low, high = 0.0, seats / weights.sum()
    while count(high).sum() < seats:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if count(middle).sum() < seats else (low, middle)
    # what is left between the two are equal quotients, or such as rounding cannot tell apart
    sure, most = count(low * (1 - 1e-12)).astype(np.int64), count(high * (1 + 1e-12)).astype(np.int64)
    owner = np.repeat(np.arange(len(weights)), most - sure)
    first = np.repeat(np.cumsum(most - sure) - (most - sure), most - sure)
    quotient = weights[owner] / (2 * (sure[owner] + 1 + np.arange(len(owner)) - first) - 1)
    best = np.lexsort((turn[owner], -quotient))[: seats - sure.sum()]
    return sure + np.bincount(owner[best], minlength=len(weights))


def apportion(
    df: DataFrame, group: Sequence[str], key: str, weight: Column, seats: Column, output: str, room: Column | None = None
) -> DataFrame:
    """Sainte-Lague: give each group's ``seats`` to its keys, one by one to the highest weight / (2n - 1).

    The level at which the rounded shares sum to the seats is found by bisection, and equal quotients there
    go to the smaller key, null last.  A key wins no more than its ``room``; what it cannot take goes to the
    others.  Groups without weight get nothing.  One row per key; a task holds the keys of one group.
    """
    columns = df.columns

    def deal(table: pa.Table) -> pa.Table:
        turn = np.empty(table.num_rows, np.int64)
        turn[pc.sort_indices(table, sort_keys=[(key, "ascending")], null_placement="at_end")] = np.arange(len(turn))
        weights, room = (pc.fill_null(table[c], 0.0).to_numpy() for c in ("__w", "__room"))
        won = _won(weights, room, turn, table["__seats"][0].as_py() or 0)
        return table.select(columns).append_column(output, pa.array(won, pa.int64()))

    room = F.lit(float(1 << 62)) if room is None else room.cast("double")
    ready = df.withColumns({"__w": weight.cast("double"), "__room": room, "__seats": seats.cast("long")})
    return ready.groupBy(*group).applyInArrow(deal, StructType([*df.schema.fields, StructField(output, LongType())]))


def sizes_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _blocks_of(size: Column, block: int) -> Column:
    """Blocks of a string; the last one ends with it and is half a block shorter or longer at most."""
    return F.greatest(F.round(size / block), F.lit(1)).cast("long")


def _quotas(shards: DataFrame, weights: Sequence[int], max_repeats: int, block: int) -> DataFrame:
    """Blocks to take from every (source, shard): first by source, then by shard inside the source."""
    sources = shards.groupBy("__source").agg(
        F.first("source").alias("source"), F.sum("__size").cast("long").alias("source_size")
    )
    aimed = targets(sources, weights, max_repeats)
    all_blocks = F.round(F.sum("target").over(Window.partitionBy()) / block)
    by_source = apportion(
        aimed.withColumn("__all", all_blocks.cast("long")), [], "__source", F.col("target"), F.col("__all"), "__quota"
    ).select("__source", "source_size", "target", "__quota")
    return apportion(
        shards.drop("source").join(by_source, "__source"),
        ["__source"], "__shard", F.col("__size"), F.col("__quota"), "__blocks_taken",
        room=max_repeats * _blocks_of(F.col("__size"), block),
    )


def _dealt(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Add ``__shard`` from 0, or from -1 down for rows without words."""
    shard = F.pmod(F.xxhash64("__order"), F.coalesce("__shards", F.lit(1)))
    joined = rows.join(F.broadcast(several), ["__source", "__some"], "left")
    return joined.withColumn("__shard", F.when(F.col("__some"), shard).otherwise(-1 - shard)).drop("__some", "__shards")


def mix(
    df: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, seed: int = 11
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to rows with ``doc_id``, ``source`` and ``size``.

    Every source's rows with words are dealt to one shard per ``DOCS_PER_SHARD`` of them by a seeded hash and
    strung together in seeded order (rows without words likewise, to shards of their own); blocks of
    ``block`` words are counted along that string.  Quotas of blocks are apportioned to sources and then to
    their shards, at most ``max_repeats`` times a shard's blocks; seats beyond go to the source's other shards.
    A shard with m blocks and a quota of q gives each block q div m times and q mod m of them
    once more, evenly spread from a seeded start.  What a document gives is a difference of two counts, so
    blocks are never rows.  ``copies`` is the number of whole repeats in ``taken``; with ``place``,
    ``blocks``, ``extra_blocks`` and ``phase``, :func:`chosen` tells which further words are taken.

    Null sources are one source, the last; a document of size 0 gives 0; no document gives more than
    ``max_repeats`` sizes.  Rows that share an id, or have none, are separate documents, equal rows too: they
    differ in ``taken`` only, and which of them has which value is not defined.  The result depends on
    ids, sizes and sources only.  An empty table gives no rows.  Other columns stay, those with an output's
    name are replaced.
    """
    with Scratch(df.sparkSession, "mixing") as scratch:
        ordered = df.withColumns(
            {
                "__order": F.xxhash64("doc_id", "size", F.lit(seed)),
                "__source": F.concat(F.when(F.col("source").isNull(), "~").otherwise("="), F.coalesce("source", F.lit(""))),
                "__some": F.coalesce(F.col("size") > 0, F.lit(False)),
            }
        )
        # a few numbers per row, so that texts are not counted again
        sizes = scratch.keep(ordered.select("__source", "source", "__some", "__order", "size"), "sizes")
        counted = sizes.groupBy("__source", "__some").agg(F.ceil(F.count("*") / DOCS_PER_SHARD).alias("__shards"))
        # sources of one shard are left out, so the list has a row per DOCS_PER_SHARD rows at most
        several = Scratch(df.sparkSession, "mixing-shards").hand_over(counted.where("__shards > 1"))
        shards = _dealt(sizes, several).groupBy("__source", "__shard").agg(
            F.first("source").alias("source"), F.sum("size").cast("long").alias("__size")
        )
        quotas = scratch.hand_over(_quotas(scratch.keep(shards, "shards"), weights, max_repeats, block))
    string = Window.partitionBy("__source", "__shard").orderBy("__order", "doc_id", "size")
    n_blocks, quota = _blocks_of(F.col("__size"), block), F.col("__blocks_taken")
    whole = F.floor(quota / n_blocks).cast("long")
    outputs = {
        # by rows: equal rows follow each other instead of sharing the place of the last
        "place": F.coalesce(F.sum("size").over(string.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "blocks": n_blocks,
        "copies": whole,
        "extra_blocks": quota - whole * n_blocks,
        "phase": F.pmod(F.xxhash64("__source", "__shard", F.lit(seed)), n_blocks),
    }
    placed = (
        _dealt(ordered.drop("source_size", "target"), several)
        .join(quotas, ["__source", "__shard"]).withColumns(outputs)
        .drop("__size", "__quota", "__blocks_taken", "__order", "__source", "__shard")
    )
    given = _before(F.col("place") + F.col("size"), block) - _before(F.col("place"), block)
    return placed.withColumn("taken", F.col("copies") * F.col("size") + given)


def _spread(i: Column) -> Column:
    """How many of the first ``i`` blocks are taken once more: evenly spread, moved by the phase."""
    return F.floor((i * F.col("extra_blocks") + F.col("phase")) / F.col("blocks")).cast("long")


def _block(word: Column, block: int) -> Column:
    return F.least(F.floor(word / block).cast("long"), F.col("blocks") - 1)


def _before(word: Column, block: int) -> Column:
    """Words taken once more among the first ``word`` words of the string."""
    i = _block(word, block)
    return block * _spread(i) + (word - block * i) * (_spread(i + 1) - _spread(i))


def chosen(position: Column, block: int = BLOCK_WORDS) -> Column:
    """Is the document's word at ``position`` (from 0) taken once more?"""
    i = _block(F.col("place") + position, block)
    return _spread(i + 1) > _spread(i)
