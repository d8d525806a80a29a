"""Event schema normalisation and per-event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventstrand.operators.histories import ORDER, Histories, segment_carry, user_keys

# Event codes with a cash-flow meaning, and the default value scaling.
OUTFLOW_EVENTS = (2, 4)
INFLOW_EVENTS = (3, 5, 19)
RISK_EVENT = 21
VALUE_MEAN = 23.1213
VALUE_STD = 459.0598


def normalise_events(raw: DataFrame) -> DataFrame:
    """Cast to the event schema, default a missing product to 0, drop rows without a user.

    ``event_id`` orders events of the same time; without that column, arrival order is used.  It must
    be taken from a scan then, where row numbers are the same on every attempt.
    """
    given = {c.lower() for c in raw.columns}
    event_id = F.col("event_id") if "event_id" in given else F.monotonically_increasing_id()
    return raw.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("timestamp_event").alias("timestamp_event"),
        event_id.cast("bigint").alias("event_id"),
        F.col("value").cast("float").alias("value"),
        F.col("event_type").cast("tinyint").alias("event_type"),
        F.coalesce(F.col("product_id").cast("bigint"), F.lit(0)).alias("product_id"),
        *[F.col(c).alias(c) for c in ("bucket", "part", "split") if c in given],
    ).where(F.col("user_id").isNotNull())


def net_cashflow() -> Column:
    """Signed value of an event: negative for outflow and risk, positive for inflow, otherwise 0."""
    code, value = F.col("event_type"), F.col("value")
    return (
        F.when(code.isin(*OUTFLOW_EVENTS, RISK_EVENT), -value)
        .when(code.isin(*INFLOW_EVENTS), value)
        .otherwise(F.lit(0.0))
        .cast("float")
    )


def with_cashflow(histories: Histories) -> Histories:
    return histories.map(lambda df: df.withColumn("net_cashflow", net_cashflow()))


def _running_columns(df: DataFrame, *keys: str) -> DataFrame:
    """Position, predecessor and running sum inside each partition of ``keys``: one shuffle, one sort."""
    ordered = Window.partitionBy(*keys).orderBy(*ORDER)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {
            "pos": F.row_number().over(ordered).cast("bigint") - 1,
            "n_events": F.count(F.lit(1)).over(
                ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
            "previous_ts": F.lag("timestamp_event").over(ordered),
            "previous_flow": F.lag("net_cashflow").over(ordered),
            "flow_before": F.coalesce(F.sum("net_cashflow").over(before), F.lit(0.0)),
        }
    )


def _segmented_running_columns(heavy: DataFrame) -> DataFrame:
    """The same columns for segmented users: local values plus the carry of earlier segments."""
    first = F.col("pos") == 0
    return (
        _running_columns(heavy, "user_id", "segment")
        .drop("n_events")
        .join(segment_carry(heavy), ["user_id", "segment"])
        .withColumns(
            {
                "previous_ts": F.when(first, F.col("carry_ts")).otherwise(F.col("previous_ts")),
                "previous_flow": F.when(first, F.col("carry_last_flow")).otherwise(
                    F.col("previous_flow")
                ),
                "flow_before": F.col("flow_before") + F.col("carry_flow"),
                "pos": F.col("pos") + F.col("carry_pos"),
            }
        )
    )


def _derived_columns(df: DataFrame, value_mean: float, value_std: float) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("previous_ts"), F.col("timestamp_event"))
    df = df.withColumns(
        {
            "time_delta": F.coalesce(seconds, F.lit(0)),
            # An unknown flow leaves the balance unknown for the next event, which counts as 0.
            "balance": F.when(F.col("previous_flow").isNull(), F.lit(0.0)).otherwise(
                F.col("flow_before")
            ),
        }
    )
    value = F.coalesce(F.col("value"), F.lit(0.0)).cast("double")
    return df.select(
        *user_keys(df),
        *(["segment"] if "segment" in df.columns else []),
        "timestamp_event",
        "event_id",
        "pos",
        "n_events",
        "value",
        "event_type",
        "product_id",
        "net_cashflow",
        "time_delta",
        "balance",
        ((value - F.lit(value_mean)) / F.lit(value_std)).cast("float").alias("value_norm"),
        F.log1p("time_delta").cast("float").alias("time_delta_norm"),
        F.log1p(F.abs("balance")).cast("float").alias("balance_norm"),
    )


def event_features(
    histories: Histories, value_mean: float = VALUE_MEAN, value_std: float = VALUE_STD
) -> Histories:
    """Time gap, running balance before the event, and normalised features, in event order per user."""
    flows = with_cashflow(histories)
    running = Histories(
        _running_columns(flows.regular, *user_keys(flows.regular)),
        None if flows.heavy is None else _segmented_running_columns(flows.heavy),
    )
    return running.map(lambda df: _derived_columns(df, value_mean, value_std))
