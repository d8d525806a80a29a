"""Vector functions on ``array<float|double>`` columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def mean_pool(matrix: Column) -> Column:
    """Element-wise mean of the rows of an ``array<array<..>>`` column; null for no rows."""
    rows = matrix.cast("array<array<double>>")
    total = F.aggregate(
        F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
        F.get(rows, F.lit(0)),
        lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y),
    )
    return F.transform(total, lambda x: x / F.size(rows))


def log_sum_exp(scores: Column) -> Column:
    """log(sum(exp(scores))), shifted by the largest score so that exp cannot overflow."""
    top = F.array_max(scores).cast("double")
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return top + F.log(total)


def l2_normalize(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Scale each vector to unit length; a zero vector stays zero."""
    output = output or column
    vector, scaled = f"__{output}_vector", f"__{output}_scaled"
    normalised = Normalizer(p=2.0, inputCol=vector, outputCol=scaled).transform(
        df.withColumn(vector, array_to_vector(F.col(column).cast("array<double>")))
    )
    return normalised.withColumn(output, vector_to_array(scaled)).drop(vector, scaled)
