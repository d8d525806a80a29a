"""Overlapping fixed-length sequence windows with next-event targets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventstrand.functions.sequences import int_div
from eventstrand.operators.histories import ORDER, Histories, user_keys

FEATURES = ("value_norm", "time_delta_norm", "balance_norm")
_EVENTS_AT_ONCE = 1 << 20  # in the lists of one batch


@dataclass(frozen=True)
class WindowSpec:
    """Window length and stride; histories above ``stride_threshold`` step by a whole window."""

    length: int = 1000
    stride: int = 500
    stride_threshold: int = 3000
    min_events: int | None = None
    max_windows: int | None = None


def covering_starts(pos: Column, n_events: Column, spec: WindowSpec) -> Column:
    """Starts of all windows that need the event at ``pos``, as an input or as the last target.

    Window starts are the multiples of the stride up to ``n - length - 1`` plus that last start
    itself, so the ones in reach of a position follow by arithmetic; no history has to be gathered.
    """
    length = spec.length
    stride = (
        F.when(n_events > spec.stride_threshold, F.lit(length)).otherwise(F.lit(spec.stride))
    ).cast("bigint")
    last = F.greatest(n_events - (length + 1), F.lit(0).cast("bigint"))
    reach = F.greatest(pos - length, F.lit(0).cast("bigint"))

    first_step = int_div(reach + stride - 1, stride)
    last_step = int_div(F.least(pos, last), stride)
    tail = (last % stride != 0) & (pos >= last)
    if spec.max_windows is not None:
        last_step = F.least(last_step, F.lit(spec.max_windows - 1).cast("bigint"))
        tail = tail & (int_div(last, stride) + 2 <= spec.max_windows)
    none = F.array().cast("array<bigint>")
    regular = F.when(
        first_step <= last_step, F.sequence(first_step * stride, last_step * stride, stride)
    ).otherwise(none)
    return F.concat(regular, F.when(tail, F.array(last)).otherwise(none))


def _event_struct() -> Column:
    return F.struct("pos", "event_type", "product_id", F.struct(*FEATURES).alias("num_feats"))


def _assemble_segments(features: DataFrame, spec: WindowSpec) -> DataFrame:
    """Windows of users cut into segments: their events are grouped by (user, window start).

    A window may lie across two segments, so its events, at most ``length + 1``, are shuffled together.
    """
    keys = user_keys(features)
    if spec.min_events is not None:
        features = features.where(F.col("n_events") >= spec.min_events)
    starts = covering_starts(F.col("pos"), F.col("n_events"), spec)
    events = F.col("events")
    return (
        features.select(
            *keys, "n_events", _event_struct().alias("event"), F.explode(starts).alias("window_start")
        )
        .groupBy(*keys, "n_events", "window_start")
        .agg(F.sort_array(F.collect_list("event")).alias("events"))
        .select(
            *keys,
            "window_start",
            "n_events",
            F.slice(events["event_type"], 1, spec.length).alias("input_event_seq"),
            F.slice(events["product_id"], 1, spec.length).alias("input_product_seq"),
            F.slice(events["num_feats"], 1, spec.length).alias("num_feats_seq"),
            F.slice(events["event_type"], 2, spec.length).alias("target_event_seq"),
        )
    )


def ending_starts(pos: np.ndarray, n_events: np.ndarray, spec: WindowSpec) -> np.ndarray:
    """Start of the window whose last event is the one at ``pos``; -1 where none ends.

    A window that starts at s ends with the event at s + length, its last target, or with the user's last
    event.  Every event ends one window at most, so a history can be cut while it streams by.
    """
    length = spec.length
    stride = np.where(n_events > spec.stride_threshold, length, spec.stride)
    last = np.maximum(n_events - length - 1, 0)
    start = np.where(n_events > length, pos - length, 0)
    ends = np.where(n_events > length, start >= 0, pos == n_events - 1)
    regular = start % stride == 0
    ends &= (regular | (start == last)) & (start <= last)
    if spec.max_windows is not None:
        ends &= np.where(regular, start // stride, last // stride + 1) < spec.max_windows
    if spec.min_events is not None:
        ends &= n_events >= spec.min_events
    return np.where(ends, start, -1)


def _ordered(features: DataFrame) -> DataFrame:
    """Rows of a user one after the other in event order.

    Features come out of a window function in that very order, so no sort is added.
    """
    return features.sortWithinPartitions(*user_keys(features), *ORDER).select(
        *user_keys(features), "n_events", "pos", "event_type", "product_id", *FEATURES
    )


def _cut(
    ordered: DataFrame, reach: int, starts_at: Callable[[np.ndarray, np.ndarray], np.ndarray],
    lists_of: Callable[[Callable[[str, int], pa.Array]], dict[str, pa.Array]], extra: str, schema: str,
) -> DataFrame:
    """One row for each run of events [start, pos] of a user that ends at a ``pos``.

    ``starts_at(pos, n_events)`` tells where a run that ends at a position starts, at most ``reach`` events
    before, or -1.  A task keeps the last ``reach`` rows between batches, whatever the length of a history.
    """
    keys = [c for c in ordered.columns if c not in ("pos", "event_type", "product_id", *FEATURES)]

    def lists(table: pa.Table, ends: np.ndarray, starts: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        size = pos[ends] - starts + 1
        first = ends - size + 1

        def values(name: str, from_event: int, upto: int | None = None) -> pa.Array:
            """Events ``from_event`` to ``upto`` (exclusive, all if None) of every run."""
            begin = np.minimum(from_event, size)
            stop = size if upto is None else np.minimum(size, upto)
            count = np.maximum(stop - begin, 0)
            offsets = np.concatenate([[0], np.cumsum(count)])
            at = np.repeat(first + begin - offsets[:-1], count) + np.arange(offsets[-1])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table[name].take(pa.array(at)).combine_chunks())

        columns = {name: table[name].take(pa.array(ends)).combine_chunks() for name in keys}
        columns[extra] = pa.array(starts, pa.int64())
        return pa.record_batch({**columns, **lists_of(values)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            new = 0
            if held is not None:
                new = held.num_rows
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            pos, n = table["pos"].to_numpy(), table["n_events"].to_numpy()
            starts = starts_at(pos[new:], n[new:])
            ends = np.flatnonzero(starts >= 0)
            starts, ends = starts[ends], ends + new
            step = max(1, _EVENTS_AT_ONCE // (reach + 1))
            for at in range(0, len(ends), step):
                yield lists(table, ends[at : at + step], starts[at : at + step], pos)
            held = table.slice(max(0, table.num_rows - reach))

    return ordered.mapInArrow(run, schema)


def _struct_of_features(values: Callable[..., pa.Array], *bounds: int | None) -> pa.Array:
    parts = [values(name, *bounds) for name in FEATURES]
    return pa.ListArray.from_arrays(parts[0].offsets, pa.StructArray.from_arrays([p.values for p in parts], names=list(FEATURES)))


def _key_schema(features: DataFrame) -> str:
    types = dict(features.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in user_keys(features))


_FEATURE_LIST = f"array<struct<{','.join(f'{name}:float' for name in FEATURES)}>>"


def _assemble(features: DataFrame, spec: WindowSpec) -> DataFrame:
    """Cut the windows while the events stream by in order: nothing is exploded, grouped or sorted again."""
    length = spec.length

    def lists(values: Callable[..., pa.Array]) -> dict[str, pa.Array]:
        return {
            "input_event_seq": values("event_type", 0, length),
            "input_product_seq": values("product_id", 0, length),
            "num_feats_seq": _struct_of_features(values, 0, length),
            "target_event_seq": values("event_type", 1),
        }

    schema = (
        f"{_key_schema(features)}, n_events bigint, window_start bigint, input_event_seq array<tinyint>, "
        f"input_product_seq array<bigint>, num_feats_seq {_FEATURE_LIST}, target_event_seq array<tinyint>"
    )
    cut = _cut(_ordered(features), length, lambda pos, n: ending_starts(pos, n, spec), lists, "window_start", schema)
    return cut.select(*user_keys(features), "window_start", "n_events", *[c for c in cut.columns if c.endswith("_seq")])


def sequence_windows(features: Histories, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """One row per (user, window start) with parallel input lists and the target list."""
    return assemble_windows(features, spec).rows()


def assemble_windows(features: Histories, spec: WindowSpec) -> Histories:
    """The windows of ordinary and of heavy users, still apart."""
    heavy = None if features.heavy is None else _assemble_segments(features.heavy, spec)
    return Histories(_assemble(features.regular, spec), heavy)


def normalise_windows(raw: DataFrame) -> DataFrame:
    """Window tables written elsewhere, with the same lists, in the schema of this library.

    ``window_start`` identifies a window of a user; without that column, arrival order does, which must
    be taken from a scan.
    """
    given = {c.lower() for c in raw.columns}
    start = F.col("window_start") if "window_start" in given else F.monotonically_increasing_id()
    feats = F.transform(
        "num_feats_seq", lambda f: F.struct(*[f.getField(n).cast("float").alias(n) for n in FEATURES])
    )
    return raw.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        start.cast("bigint").alias("window_start"),
        F.col("input_event_seq").cast("array<tinyint>").alias("input_event_seq"),
        F.col("input_product_seq").cast("array<bigint>").alias("input_product_seq"),
        feats.alias("num_feats_seq"),
        F.col("target_event_seq").cast("array<tinyint>").alias("target_event_seq"),
    )


def upper_case_names(windows: DataFrame) -> DataFrame:
    """The window columns and feature fields in upper case, for readers that match names exactly."""
    struct = ",".join(f"{name.upper()}:float" for name in FEATURES)
    named = windows.withColumn("num_feats_seq", F.col("num_feats_seq").cast(f"array<struct<{struct}>>"))
    return named.select(*[F.col(c).alias(c.upper()) for c in named.columns])


def user_history(features: Histories, chunk_length: int = 1000) -> DataFrame:
    """Ordered parallel lists per user, in chunks of ``chunk_length`` events.

    A whole history has no size bound, so it is never put into one row; chunk ``c`` holds positions
    ``c * chunk_length`` onwards and ``n_events`` tells the full length.
    """

    names = ("event_type", "product_id", "num_feats")

    def segments(df: DataFrame) -> DataFrame:
        chunk = int_div(F.col("pos"), F.lit(chunk_length))
        return (
            df.select(*user_keys(df), "n_events", chunk.alias("chunk"), _event_struct().alias("event"))
            .groupBy(*user_keys(df), "n_events", "chunk")
            .agg(F.sort_array(F.collect_list("event")).alias("events"))
            .select(*user_keys(df), "n_events", "chunk", *[F.col("events")[name].alias(name) for name in names])
        )

    def starts_at(pos: np.ndarray, n_events: np.ndarray) -> np.ndarray:
        ends = ((pos + 1) % chunk_length == 0) | (pos == n_events - 1)
        return np.where(ends, pos - pos % chunk_length, -1)

    def lists(values: Callable[..., pa.Array]) -> dict[str, pa.Array]:
        return {"event_type": values("event_type", 0), "product_id": values("product_id", 0), "num_feats": _struct_of_features(values, 0)}

    regular = features.regular
    schema = (
        f"{_key_schema(regular)}, n_events bigint, start bigint, event_type array<tinyint>, product_id array<bigint>, "
        f"num_feats {_FEATURE_LIST}"
    )
    cut = _cut(_ordered(regular), chunk_length - 1, starts_at, lists, "start", schema)
    chunks = cut.select(*user_keys(regular), "n_events", int_div(F.col("start"), F.lit(chunk_length)).alias("chunk"), *names)
    return Histories(chunks, None if features.heavy is None else segments(features.heavy)).rows()


def history_filter_counts(events: DataFrame, min_events: int) -> DataFrame:
    """How many users pass and how many are dropped by the minimum-history filter."""
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count_if(F.col("n") >= min_events).alias("users_kept"),
        F.count_if(F.col("n") < min_events).alias("users_dropped"),
    )
