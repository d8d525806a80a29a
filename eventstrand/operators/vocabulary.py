"""Product vocabulary: compact ids 1..N, 0 for padding and unknown products."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventstrand.operators.ranking import global_row_number

MAX_BROADCAST_PRODUCTS = 4_000_000


def product_vocabulary(windows: DataFrame) -> DataFrame:
    """(orig_id, new_id) over the products that occur as window inputs, numbered in id order."""
    ids = (
        windows.select(F.explode("input_product_seq").alias("orig_id"))
        .where(F.col("orig_id").isNotNull() & (F.col("orig_id") != 0))
        .distinct()
    )
    return global_row_number(ids, ["orig_id"], "new_id")


def product_remapper(
    vocabulary: DataFrame, max_broadcast: int = MAX_BROADCAST_PRODUCTS
) -> Callable[[DataFrame], DataFrame]:
    """Function that replaces the product ids of windows by vocabulary ids, unknown ones by 0.

    A vocabulary of up to ``max_broadcast`` ids is sent to the executors and the lists are translated
    where they are; a larger one is joined to the distinct ids of each window.  Both ways give the same
    rows: null lists stay null, null elements become 0, rows with equal keys stay as many as they are.
    """
    head = vocabulary.select("orig_id", "new_id").limit(max_broadcast + 1).toPandas()
    if len(head) <= max_broadcast:
        return partial(_remap_by_lookup, vocabulary=head.sort_values("orig_id"))
    return partial(_remap_by_join, vocabulary=vocabulary)


def remap_products(
    windows: DataFrame, vocabulary: DataFrame, max_broadcast: int = MAX_BROADCAST_PRODUCTS
) -> DataFrame:
    return product_remapper(vocabulary, max_broadcast)(windows)


def _remap_by_lookup(windows: DataFrame, vocabulary: pd.DataFrame) -> DataFrame:
    shared = windows.sparkSession.sparkContext.broadcast(
        (vocabulary["orig_id"].to_numpy("int64"), vocabulary["new_id"].to_numpy("int64"))
    )

    @F.arrow_udf("array<bigint>")
    def translate(lists: pa.Array) -> pa.Array:
        known, new_ids = shared.value
        elements = lists.flatten()
        values = elements.fill_null(0).to_numpy(zero_copy_only=False)
        if len(known) == 0:
            translated = np.zeros_like(values)
        else:
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            translated = np.where(known[place] == values, new_ids[place], 0)
        ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        offsets = pa.array(np.concatenate([[0], ends]).astype("int32"))
        return pa.ListArray.from_arrays(offsets, pa.array(translated), mask=lists.is_null())

    # nondeterministic only in name: keeps the planner from evaluating it twice
    return windows.withColumn("input_product_seq", translate.asNondeterministic()("input_product_seq"))


def _remap_by_join(windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct known ids per window meet the vocabulary and come back as one map per window key.

    Padding and missing products, the most frequent values, never enter the shuffle.  A map depends on
    ids only, so rows that share a key may share it.
    """
    key = ["user_id", "window_start"]
    real = lambda p: p.isNotNull() & (p != 0)
    ids = windows.select(*key, F.explode(F.array_distinct(F.filter("input_product_seq", real))).alias("orig_id")).distinct()
    maps = (
        ids.join(vocabulary.select("orig_id", "new_id"), "orig_id")
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("orig_id", "new_id"))).alias("__map"))
    )
    translated = F.transform(
        "input_product_seq", lambda p: F.coalesce(F.when(p.isNotNull(), F.try_element_at("__map", p)), F.lit(0))
    )
    return (
        windows.join(maps, key, "left").withColumn("input_product_seq", translated).drop("__map")
        .select(windows.columns)
    )
