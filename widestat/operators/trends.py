"""The questions the analysis notebook answers by eye from charts,
answered as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend(df: DataFrame, key: str, t: str, y: str) -> DataFrame:
    """Per series: points, least-squares slope of ``y`` on ``t``, and the
    first/last value with their change ("steadily gone down" = slope < 0)."""
    return (df.filter(F.col(y).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.regr_slope(F.col(y).cast("double"), F.col(t).cast("double")).alias("slope"),
                 F.min(t).alias("first_t"), F.max(t).alias("last_t"),
                 F.min_by(y, t).alias("first_value"), F.max_by(y, t).alias("last_value"))
            .withColumn("change", F.col("last_value") - F.col("first_value")))


def co_movement(df: DataFrame, key: str, y1: str, y2: str) -> DataFrame:
    """Per series: Pearson correlation of two measures over time (null when a
    measure does not vary).

    Written as covariance over the product of deviations with ``try_divide``:
    under ANSI, ``corr`` of a constant series raises a division by zero.
    """
    a, b = F.col(y1).cast("double"), F.col(y2).cast("double")
    return (df.filter(F.col(y1).isNotNull() & F.col(y2).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("corr")))


def series_gap(df: DataFrame, key: str, t: str, y: str, a: str, b: str) -> DataFrame:
    """Per time point: series ``a``, series ``b`` and ``a - b`` (core vs
    enlarged aggregate)."""
    return (df.filter(F.col(key).isin(a, b))
            .groupBy(t)
            .agg(F.max(F.when(F.col(key) == a, F.col(y))).alias("a_value"),
                 F.max(F.when(F.col(key) == b, F.col(y))).alias("b_value"))
            .withColumn("gap", F.col("a_value") - F.col("b_value")))


def risers(df: DataFrame, key: str, t: str, y: str, base: int, year: int,
           members: Sequence[str] | None = None) -> DataFrame:
    """Series whose value at ``year`` is above their value at ``base``.

    ``members`` restricts the answer to a declared membership list instead of
    "every label that is not an aggregate"."""
    if members is not None:
        df = df.filter(F.col(key).isin(list(members)))
    per = (df.filter(F.col(t).isin(base, year))
           .groupBy(key)
           .agg(F.max(F.when(F.col(t) == base, F.col(y))).alias("base_value"),
                F.max(F.when(F.col(t) == year, F.col(y))).alias("value")))
    return (per.withColumn("change", F.col("value") - F.col("base_value"))
            .filter(F.col("change") > 0))
