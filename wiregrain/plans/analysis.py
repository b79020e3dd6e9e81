"""The three whole jobs: analyse captures, train a classifier, score captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from wiregrain.operators.decode import PROTOCOLS, capture_audit, decode
from wiregrain.operators.detect import (
    FEATURES,
    packet_ml_features,
    score,
    stratified_split,
    train_classifier,
)
from wiregrain.operators.features import all_features
from wiregrain.operators.fingerprint import GROUP_COLUMNS, frequency_distributions, group_stats
from wiregrain.operators.inference import capture_verdicts
from wiregrain.operators.labels import KEYS, known_captures, label_packets, labelled_only
from wiregrain.operators.rules import anomaly_report, flag_anomalies
from wiregrain.operators.stats import summary_report
from wiregrain.session import settle
from wiregrain.sources import captures as cap
from wiregrain.sources.labels import read_labels
from wiregrain.sources.sinks import save_analysis, save_anomalies, save_features, save_fingerprint


@dataclass
class Analysis:
    features: DataFrame
    summary: DataFrame
    audit: DataFrame
    anomalies: DataFrame
    fingerprint: DataFrame
    distributions: DataFrame


def extract_features(packets: DataFrame, protocol: str, keep_invalid: bool = False) -> DataFrame:
    """All packet features of one protocol; captures without a valid packet give no rows."""
    p = PROTOCOLS[protocol]
    return all_features(decode(packets, p, keep_invalid), p)


def analyse(packets: DataFrame, protocol: str) -> Analysis:
    """Features, flags, summary and fingerprint of every capture in one set of jobs.

    The features feed seven results, so they are settled once; the flags on top of them
    cost a broadcast of the small baseline.
    """
    flagged = flag_anomalies(settle(extract_features(packets, protocol)))
    groups = ["capture_id", *GROUP_COLUMNS]
    measured = ["packet_length", "time_delta", "payload_entropy", "function_code"]
    return Analysis(
        features=flagged,
        summary=summary_report(flagged),
        audit=capture_audit(packets, PROTOCOLS[protocol]),
        anomalies=anomaly_report(flagged),
        fingerprint=group_stats(flagged, groups, measured),
        distributions=frequency_distributions(flagged, groups, measured),
    )


def analyse_directory(spark: SparkSession, root: str, protocol: str, out: str) -> Analysis:
    """Read captures, analyse them and write every export."""
    result = analyse(cap.read_packets(spark, root), protocol)
    save_analysis(result.features, out)
    save_features(result.summary, f"{out}/summary", "json")
    save_fingerprint(
        result.fingerprint, result.distributions, out, ["capture_id", *GROUP_COLUMNS]
    )
    save_anomalies(result.anomalies, f"{out}/anomalies")
    return result


def training_set(spark: SparkSession, root: str) -> DataFrame:
    """Labelled packet features of all captures under ``root``, with protocol directory and capture."""
    files = cap.list_captures(spark, root)
    features = packet_ml_features(cap.read_packets(spark, root))
    labels = known_captures(read_labels(spark, root, files), files)
    rows = labelled_only(label_packets(features, labels))
    tags = files.select("capture_id", "source_dir")
    return rows.drop("protocol").join(tags, "capture_id").withColumnRenamed("source_dir", "protocol")


def train(dataset: DataFrame, **forest: object) -> tuple[PipelineModel, DataFrame]:
    """Model and its scored test rows."""
    parts = settle(stratified_split(dataset, "label", KEYS))
    model = train_classifier(parts.where(~parts["is_test"]), FEATURES, **forest)
    return model, score(model, parts.where("is_test"))


def score_directory(
    spark: SparkSession, root: str, model: PipelineModel
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored packets, one verdict per capture, and the files that could not be read."""
    parts = cap.read_parts(spark, root)
    scored = settle(score(model, packet_ml_features(cap.read_packets(spark, root, parts=parts))))
    return scored, capture_verdicts(scored), cap.bad_files(parts)
