"""Raw events to the sequence-window dataset."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame

from eventstrand.operators.features import VALUE_MEAN, VALUE_STD, event_features, normalise_events
from eventstrand.operators.histories import MAX_EVENTS_PER_TASK, Histories, open_histories, prepare_histories, split_histories
from eventstrand.operators.vocabulary import product_vocabulary
from eventstrand.operators.windows import WindowSpec, assemble_windows, history_filter_counts, sequence_windows
from eventstrand.session import folder_exists
from eventstrand.sources.sinks import PARTS_PER_BUCKET, gather_buckets, write_resumable
from eventstrand.sources.tables import read_parquet_folder


def features_of(
    raw: DataFrame,
    value_mean: float = VALUE_MEAN,
    value_std: float = VALUE_STD,
    max_events: int = MAX_EVENTS_PER_TASK,
    prepared: str | None = None,
) -> Histories:
    """``prepared`` is the folder of :func:`prepare_dataset`, if heavy users were found before."""
    events = normalise_events(raw)
    histories = split_histories(events, max_events) if prepared is None else open_histories(events, prepared)
    return event_features(histories, value_mean, value_std)


def prepare_dataset(
    raw: DataFrame, path: str, max_events: int = MAX_EVENTS_PER_TASK, min_segment: int | None = None
) -> str:
    """Find the heavy users of raw events and store their segments below ``path``, which is returned."""
    prepare_histories(normalise_events(raw), path, max_events, min_segment)
    return path


def build_windows(
    raw: DataFrame,
    spec: WindowSpec = WindowSpec(),
    value_mean: float = VALUE_MEAN,
    value_std: float = VALUE_STD,
    max_events: int = MAX_EVENTS_PER_TASK,
    prepared: str | None = None,
) -> DataFrame:
    """Raw events (user_id, timestamp_event, value, event_type, product_id[, event_id]) to windows."""
    return sequence_windows(features_of(raw, value_mean, value_std, max_events, prepared), spec)


def build_bucketed_windows(
    raw: DataFrame,
    spec: WindowSpec = WindowSpec(),
    value_mean: float = VALUE_MEAN,
    value_std: float = VALUE_STD,
    max_events: int = MAX_EVENTS_PER_TASK,
) -> DataFrame:
    """The same from events with ``bucket`` and ``part`` columns; rows come out gathered by both.

    Events are partitioned by bucket and part once, which serves the per-user steps and the file layout,
    so the windows (several times their size) of ordinary users are not shuffled again to be written,
    however many buckets there are.
    """
    extra = [c for c in ("bucket", "part", "split") if c in raw.columns]
    histories = split_histories(normalise_events(raw), max_events)
    gathered = Histories(histories.regular.repartition(*[c for c in extra if c != "split"]), histories.heavy)
    windows = assemble_windows(event_features(gathered, value_mean, value_std), spec)
    if windows.heavy is not None:
        windows = Histories(windows.regular, gather_buckets(windows.heavy))
    return windows.rows()


def write_dataset(
    raw: DataFrame,
    path: str,
    n_buckets: int,
    spec: WindowSpec = WindowSpec(),
    buckets_per_job: int | None = None,
    parts: int = PARTS_PER_BUCKET,
    split: DataFrame | None = None,
    source: str | None = None,
    **options,
) -> DataFrame:
    """Write the windows bucket by bucket, resuming an earlier run; then the vocabulary and the user counts.

    Each bucket is ``parts`` tasks and files.  ``split`` (user_id, split) is attached to the narrow events
    and stored as a folder level, so later readers prune by it; users without a split are left out.
    ``source`` names the input; a run with other settings, another source or other rows (events or split) than
    the first is refused, and so is a dataset of which buckets failed.  Vocabulary and user counts come from the complete dataset and
    are never rewritten: models and training tables may rely on the ids.  Leaves ``path/windows``,
    ``path/done``, ``path/vocabulary`` and ``path/user_counts``; returns the window table.
    """
    spark = raw.sparkSession
    events = raw if split is None else raw.join(split.select("user_id", "split"), "user_id")
    settings = {"spec": asdict(spec), "split": split is not None, "source": source, **options}
    write_resumable(
        events, lambda part: build_bucketed_windows(part, spec, **options), f"{path}/windows", f"{path}/done",
        n_buckets, buckets_per_job, parts=parts, settings=settings,
    )
    windows = read_parquet_folder(spark, f"{path}/windows")
    for name, table in (
        ("vocabulary", lambda: product_vocabulary(windows)),
        ("user_counts", lambda: history_filter_counts(normalise_events(events), spec.min_events or 0)),
    ):
        if not folder_exists(spark, f"{path}/{name}/_SUCCESS"):
            table().write.mode("overwrite").parquet(f"{path}/{name}")
    return windows
