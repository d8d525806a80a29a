"""Sequence windows to tensor-ready training and validation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventstrand.operators.ranking import seeded_batches
from eventstrand.operators.splits import train_val_rows
from eventstrand.operators.tensors import mask_events, pad_windows
from eventstrand.operators.vocabulary import product_remapper

TRAIN_MASK, VAL_MASK = 0.4, 0.15


def training_tables(
    windows: DataFrame,
    split: DataFrame | None,
    vocabulary: DataFrame,
    length: int,
    batch_size: int = 512,
    with_balance: bool = True,
    contrastive: bool = True,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """``train`` and ``val``: remapped, padded, in seeded batches, with a masked second view.

    Rows are selected first, so the scan prunes buckets; they are placed in batches as they are stored,
    and only then translated, padded and masked, so nothing made here is shuffled.
    """
    remap = product_remapper(vocabulary)
    sides = train_val_rows(windows, split)
    tables = {}
    for side, probability in (("train", TRAIN_MASK), ("val", VAL_MASK)):
        chosen = sides.where(F.col("side") == side).drop("side")
        rows = seeded_batches(chosen, ["user_id", "window_start"], batch_size, seed)
        rows = pad_windows(remap(rows), length, with_balance)
        tables[side] = mask_events(rows, probability, seed) if contrastive else rows
    return tables
