"""Distribution tables behind the charts: histograms, entropy classes, class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.constants import ENTROPY_CLASSES, ENTROPY_TOP_CLASS, LABELS
from wiregrain.operators.fingerprint import histogram_bin
from wiregrain.operators.spread import join_null_safe
from wiregrain.operators.stats import share_counts


def histogram(df: DataFrame, column: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the key's own range, empty bins included."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(*keys, x.alias("x"))
    span = [F.min("x").alias("lo"), F.max("x").alias("hi")]
    if keys:
        rows = join_null_safe(rows, rows.groupBy(*keys).agg(*span), keys, "inner")
    else:
        edges = rows.agg(F.struct(*span).alias("s"))
        rows = rows.withColumns({"lo": edges.scalar()["lo"], "hi": edges.scalar()["hi"]})
    counted = (
        rows.withColumn("bin", histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
        .groupBy(*keys, "lo", "hi", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most `bins` rows per key from here on.
    per_key = counted.groupBy(*keys, "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return per_key.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_hi"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("long").alias("n"),
    )


def entropy_classes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return share_counts(df, keys, "entropy_classification")


ENTROPY_CLASS_NAMES = [text for _, text in ENTROPY_CLASSES] + [ENTROPY_TOP_CLASS]


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage of each of the four labels, 0 for a label that does not occur."""
    present = df.where(F.col(label).isin(list(LABELS)))
    counts = present.agg(*[F.count_if(F.col(label) == name).alias(name) for name in LABELS])
    total = sum((F.col(name) for name in LABELS), F.lit(0))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("label"),
                F.lit(number).alias("numeric_label"),
                F.col(name).alias("n"),
                (F.col(name) / F.nullif(total, F.lit(0)) * 100).alias("percentage"),
            )
            for name, number in LABELS.items()
        ]
    )
    return counts.select(F.inline(rows))


def class_by_protocol(df: DataFrame, protocol: str = "protocol", label: str = "label") -> DataFrame:
    """Protocol by label counts with a fixed column per label."""
    return df.groupBy(protocol).pivot(label, list(LABELS)).count().fillna(0, list(LABELS))


def protocol_counts(df: DataFrame, protocol: str = "protocol") -> DataFrame:
    return share_counts(df, (), protocol)
