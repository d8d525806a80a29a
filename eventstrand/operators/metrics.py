"""Class support and weights, classification metrics, similarity summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventstrand.functions.sequences import PADDING, int_div
from eventstrand.functions.vectors import dot
from eventstrand.session import materialise

# Number of event classes, the reinforced risk class and its factor, and the class
# support the default weights are made from.
N_CLASSES = 21
RISK_CLASS = 21
RISK_FACTOR = 2.5
DEFAULT_SUPPORT = {
    1: 77736,
    2: 431737,
    3: 219415,
    4: 114894,
    5: 27734,
    6: 116,
    7: 11511,
    8: 370,
    9: 16691,
    11: 16223,
    13: 159,
    14: 1,
    15: 625,
    17: 221349,
    18: 2652,
    19: 2459,
    20: 6774,
    21: 15876,
}


def class_support(df: DataFrame, column: str = "event_type") -> DataFrame:
    """(event_type, support): number of rows per class."""
    return df.groupBy(F.col(column).cast("int").alias("event_type")).agg(
        F.count(F.lit(1)).alias("support")
    )


def default_support(spark: SparkSession) -> DataFrame:
    """The fixed class support as a table."""
    return spark.createDataFrame(list(DEFAULT_SUPPORT.items()), "event_type int, support bigint")


def class_weights(
    support: DataFrame,
    n_classes: int = N_CLASSES,
    risk_class: int = RISK_CLASS,
    risk_factor: float = RISK_FACTOR,
) -> DataFrame:
    """Smoothed log weights for classes 0..n_classes; unseen classes count once, padding weighs 0."""
    # n_classes + 1 rows, so broadcasting the counts and summing in one task are both bounded
    classes = support.sparkSession.range(n_classes + 1).select(F.col("id").cast("int").alias("event_type"))
    known = support.where(F.col("event_type").between(0, n_classes))
    counted = classes.join(F.broadcast(known), "event_type", "left").select(
        "event_type", F.greatest(F.coalesce("support", F.lit(1)), F.lit(1)).alias("count")
    )
    total = F.sum("count").over(Window.partitionBy())
    weight = F.log1p(total / (F.lit(n_classes) * F.col("count")))
    return counted.withColumn("weight", weight).select(
        "event_type",
        "count",
        F.when(F.col("event_type") == PADDING, F.lit(0.0))
        .when(F.col("event_type") == risk_class, F.col("weight") * risk_factor)
        .otherwise(F.col("weight"))
        .alias("weight"),
    )


def prediction_pairs(df: DataFrame, target_seq: str, pred_seq: str, *keep: str) -> DataFrame:
    """Aligned (target, pred) rows over the common length of both lists, without padded targets."""
    pairs = F.arrays_zip(F.col(target_seq).alias("target"), F.col(pred_seq).alias("pred"))
    return (
        df.select(*keep, F.posexplode(pairs).alias("i", "pair"))
        .select(
            *keep,
            "i",
            F.col("pair.target").cast("int").alias("target"),
            F.col("pair.pred").cast("int").alias("pred"),
        )
        .where((F.col("target") != PADDING) & F.col("pred").isNotNull())
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """(target, pred, n): at most classes squared rows."""
    return pairs.groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as target or prediction."""
    return report_of_confusion(confusion_counts(pairs))


def report_of_confusion(confusion: DataFrame) -> DataFrame:
    """The per-class report from confusion counts; each count enters its target and its prediction."""
    hit = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    as_target = F.struct(
        F.col("target").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
        hit.alias("hits"),
    )
    as_pred = F.struct(
        F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
        F.lit(0).cast("bigint").alias("hits"),
    )
    counts = (
        confusion.select(F.inline(F.array(as_target, as_pred)))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    hits = F.col("hits")
    return counts.select(
        F.col("class").cast("string").alias("class"),
        _ratio(hits, F.col("predicted")).alias("precision"),
        _ratio(hits, F.col("support")).alias("recall"),
        _ratio(2 * hits, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def macro_weighted_metrics(report: DataFrame) -> DataFrame:
    """One row with macro and support-weighted precision, recall and F1."""
    names = ("precision", "recall", "f1")
    macro = [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_macro") for m in names]
    weighted = [
        _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted") for m in names
    ]
    return report.agg(*macro, *weighted)


def pair_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``cosine`` of two already normalised vectors."""
    return pairs.withColumn("cosine", dot(F.col(a), F.col(b)))


def histogram(df: DataFrame, column: str, bins: int = 64) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the smallest and the largest value.

    The last bin includes its right edge; a single distinct value is centred in a range of width 1.  Where the
    bins lie is only known once all values were seen, so the input is read once and leaves its values, 8
    bytes a row, in a checkpoint; the ends and the counts are taken from there.
    """
    df = materialise(df.select(F.col(column).cast("double").alias(column)))
    single = F.col("lo") == F.col("hi")
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(
        F.struct(
            F.when(single, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(single, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ).alias("ends")
    )
    placed = df.where(F.col(column).isNotNull()).withColumn("ends", ends.scalar())
    width = (F.col("ends.hi") - F.col("ends.lo")) / F.lit(bins)
    bin_of = F.least(F.floor((F.col(column) - F.col("ends.lo")) / width), F.lit(bins - 1))
    counts = placed.groupBy(bin_of.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every_bin = df.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.scalar().alias("ends"))
    # at most ``bins`` rows on either side
    return every_bin.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("ends.lo") + F.col("bin") * width).alias("lower"),
        (F.col("ends.lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
