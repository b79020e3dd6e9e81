"""Outlier filters: three deviations, 99th percentile, quartile range, and deviation bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.operators.quantiles import quantile_table
from wiregrain.operators.stats import join_keys


def size_outliers(
    df: DataFrame, column: str = "packet_length", keys: Sequence[str] = (), sigmas: float = 3.0
) -> DataFrame:
    """Rows above mean plus ``sigmas`` sample deviations of their key."""
    limit = (F.avg(column) + sigmas * F.stddev_samp(column)).alias("threshold")
    return _above(df, column, df.groupBy(*keys).agg(limit), keys)


def timing_outliers(
    df: DataFrame,
    column: str = "time_delta",
    keys: Sequence[str] = (),
    prob: float = 0.99,
    stored: bool = False,
) -> DataFrame:
    """Rows above the exact quantile of their key; ``stored`` as in ``exact_quantiles``."""
    limit = quantile_table(df, {"threshold": (column, prob)}, keys, stored)
    return _above(df, column, limit, keys)


def _above(df: DataFrame, column: str, limit: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_keys(df, limit, keys).where(F.col(column) > F.col("threshold"))


def outlier_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of large packets and slow packets with their thresholds."""
    large = size_outliers(df, keys=keys).groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("n"))
    slow = timing_outliers(df, keys=keys).groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("n"))
    name = F.lit("large_packets").alias("kind")
    return large.select(*keys, name, "threshold", "n").unionByName(
        slow.select(*keys, F.lit("unusual_timing").alias("kind"), "threshold", "n")
    )


def iqr_outliers(
    df: DataFrame, column: str, keys: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    """Rows outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR with the bounds."""
    wanted = {"q1": (column, 0.25), "q3": (column, 0.75)}
    bounds = quantile_table(df, wanted, keys, stored).select(
        *keys,
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
    )
    rows = join_keys(df, bounds, keys)
    return rows.where(~F.col(column).between(F.col("low"), F.col("high")))


def deviation_bands(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``severity`` of each row: normal, flag beyond two deviations, strong beyond three."""
    base = df.groupBy(*keys).agg(
        F.avg(column).alias("__mean"), F.stddev_samp(column).alias("__std")
    )
    rows = join_keys(df, base, keys)
    off = F.abs(F.col(column) - F.col("__mean"))
    severity = (
        F.when(off > 3 * F.col("__std"), "strong").when(off > 2 * F.col("__std"), "flag")
    ).otherwise("normal")
    return rows.withColumn("severity", severity).drop("__mean", "__std")
