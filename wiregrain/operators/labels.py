"""Joining packets with their labels, and the audits around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.functions.text import label_number

KEYS = ["capture_id", "packet_number"]


def label_packets(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on capture and packet number; unlabelled packets keep NULL labels.

    Keys are unique on both sides, so a large capture spreads over all partitions.
    """
    numbered = labels.select(*KEYS, "label", label_number(F.col("label")).alias("numeric_label"))
    return features.join(numbered, KEYS, "left")


def labelled_only(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["numeric_label"])


def known_captures(labels: DataFrame, captures: DataFrame) -> DataFrame:
    """Labels of captures that exist."""
    return labels.join(captures.select("capture_id").distinct(), "capture_id", "left_semi")


def label_audit(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Per capture: packets, packets without a label, and labels outside the label set."""
    joined = label_packets(features.select(*KEYS), labels)
    return joined.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.count_if(F.col("label").isNotNull() & F.col("numeric_label").isNull()).alias("unmapped"),
    )


def unlabelled_packets(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select(*KEYS), KEYS, "left_anti")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight ``n / (classes * n_class)`` of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("s"))
    s = whole.scalar()
    return counts.withColumn("weight", s["rows"] / (s["classes"] * F.col("n")))
