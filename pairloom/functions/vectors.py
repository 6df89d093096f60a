"""Vector expressions: norms, cosine, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubled(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(doubled(a), doubled(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubled(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalised(v: Column) -> Column:
    """Unit vector; scaled by the largest entry first, so that no square overflows. A vector near zero is an error."""
    largest = F.array_max(F.transform(doubled(v), lambda x: F.abs(x)))
    scaled = F.transform(F.zip_with(doubled(v), F.array_repeat(largest, F.size(v)), lambda x, m: x / m), lambda x: x)
    length = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.zip_with(scaled, F.array_repeat(length, F.size(v)), lambda x, m: x / m)
    return F.when(largest > 1.0e-19, unit).otherwise(F.raise_error(F.lit("vector too close to zero")))


def vector_report(vectors: DataFrame, column: str, size: int, tolerance: float = 1.1e-4) -> DataFrame:
    """One row of counts: n, wrong_size, not_finite, not_unit. A catalogue is valid when the last three are 0."""
    v = doubled(F.col(column))
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.size(v), F.lit(-1)) != size).alias("wrong_size"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("not_finite"),
        F.count_if(F.abs(norm(F.col(column)) - 1) > tolerance).alias("not_unit"),
    )
