"""Exports. Every writer takes a folder and writes it in parallel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.operators.fingerprint import distribution_document
from wiregrain.operators.stats import traffic_statistics
from wiregrain.session import settle

FORMATS = ("csv", "json", "parquet")


def save_features(
    df: DataFrame,
    path: str,
    format: str = "csv",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a feature frame as CSV with header, JSON lines or Parquet."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    out = flat(df) if format == "csv" else df
    writer = out.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text and binary ones as hex, for text formats."""

    def cell(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(field.name).alias(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return F.hex(field.name).alias(field.name)
        return F.col(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def save_fingerprint(summary: DataFrame, distributions: DataFrame, path: str, keys: Sequence[str]) -> None:
    save_features(summary, f"{path}/fingerprint_summary", "csv")
    save_features(distribution_document(distributions, keys), f"{path}/freq_distributions", "json")


def save_anomalies(report: DataFrame, path: str) -> bool:
    """Write the report, once computed; say whether it has a row."""
    stored = settle(report)
    if stored.isEmpty():
        return False
    save_features(stored, path, "json")
    return True


def save_summary(report: DataFrame, path: str) -> None:
    """Summary documents (``summary_report``), one JSON line for each key; ``logs.read_summary`` reads them."""
    save_features(report, path, "json")


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames whose one-hot columns differ; a missing indicator is 0."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    ones = [c for c in whole.columns if c.startswith("fc_") and c[3:].isdigit()]
    return whole.fillna(0, ones) if ones else whole


def save_combined(frames: Sequence[DataFrame], path: str, format: str = "csv") -> None:
    save_features(combine(frames), path, format)


def save_analysis(features: DataFrame, path: str) -> None:
    """Features and traffic statistics of an analysis."""
    save_features(features, f"{path}/features", "csv")
    save_features(traffic_statistics(features), f"{path}/statistics", "json")


PREDICTION_COLUMNS = ["capture_id", "packet_number", "ts", "prediction", "confidence"]


def save_predictions(scored: DataFrame, path: str, format: str = "csv") -> None:
    probs = [c for c in scored.columns if c.startswith("prob_")]
    save_features(scored.select(*PREDICTION_COLUMNS, *probs), path, format)


def save_model(model: PipelineModel, path: str) -> None:
    """Scaler, feature order and forest in one folder."""
    model.write().overwrite().save(path)


def label_documents(labels: DataFrame, per_document: int = 10_000) -> DataFrame:
    """JSON documents in the label-file shape, each with at most ``per_document`` packets of one capture."""
    chunk = F.floor((F.col("packet_number") - 1) / per_document)
    entry = F.struct("packet_number", "label")
    docs = labels.groupBy("capture_id", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("packet_labels")
    )
    body = F.create_map("capture_id", F.struct("packet_labels"))
    return docs.select("capture_id", F.to_json(body).alias("value"))


def save_labels(labels: DataFrame, path: str) -> None:
    """Label documents, one per line, a folder per capture."""
    label_documents(labels).write.mode("overwrite").partitionBy("capture_id").text(path)
