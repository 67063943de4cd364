"""Grouped statistics: winsorised and weighted medians, information measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winsorised_median(df: DataFrame, keys: list[str], value: str, low: float, high: float, iqr: float | None = None, least: int = 4) -> DataFrame:
    """Median per group of values clipped to quantiles (or quartiles and iqr times their distance); small groups unclipped.

    Quantiles are aggregated first and joined back, so that a hot group is not sorted in one window.
    """
    q = df.groupBy(*keys).agg(F.percentile(value, [low, high]).alias("_q"), F.count(value).alias("_n"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    if iqr is not None:
        lo, hi = lo - iqr * (hi - lo), hi + iqr * (hi - lo)
    clipped = F.when(F.col("_n") < least, F.col(value)).otherwise(F.greatest(F.least(F.col(value), hi), lo))
    return df.join(q, keys).groupBy(*keys).agg(F.median(clipped).alias("median"), F.count(value).alias("n"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Where the cumulative weight share, interpolated linearly between values, reaches one half."""
    order = Window.partitionBy(*keys).orderBy(value)
    by = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    cdf = by.withColumn("_c", F.sum("_w").over(order) / F.sum("_w").over(Window.partitionBy(*keys)))
    step = cdf.withColumn("_pc", F.lag("_c").over(order)).withColumn("_pv", F.lag(value).over(order))
    at = step.where((F.col("_c") >= 0.5) & (F.coalesce("_pc", F.lit(-1.0)) < 0.5))
    middle = F.col("_pv") + (0.5 - F.col("_pc")) / (F.col("_c") - F.col("_pc")) * (F.col(value) - F.col("_pv"))
    return at.select(*keys, F.coalesce(middle, F.col(value)).alias("median"))


def pmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    return F.log(both * n / (a * b))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group and their rank (Spark limits each task's group before the shuffle)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
