"""Classifier: split, weights, scaling, training, metrics against direct computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiregrain import constants as C
from wiregrain.operators import detect as D
from wiregrain.operators import metrics as M
from wiregrain.operators import rules as R
from wiregrain.operators import timewindows as T
from wiregrain.sources.labels import register

LABELS = ["N", "P1", "P2", "P3"]


@pytest.fixture(scope="module")
def dataset(spark):
    """Four classes that two features separate, one class with most rows."""
    i = F.col("id")
    label = F.when(i % 10 < 6, 0).when(i % 10 < 8, 1).when(i % 10 == 8, 2).otherwise(3)
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    df = spark.range(600).select(
        F.lit("c").alias("capture_id"),
        i.alias("packet_number"),
        F.when(i % 2 == 0, "modbus").otherwise("dnp3").alias("protocol"),
        label.alias("numeric_label"),
        (label * 2 + noise).alias("x"),
        noise.alias("y"),
        F.lit(1.0).alias("flat"),
    )
    return df.withColumn("label", F.element_at(F.array(*map(F.lit, LABELS)), F.col("numeric_label") + 1)).cache()


def test_split_is_exact_stratified_and_repeatable(dataset):
    keys = ["capture_id", "packet_number"]
    a = D.stratified_split(dataset, "label", keys).select("packet_number", "label", "is_test")
    b = D.stratified_split(dataset.repartition(7), "label", keys).select(a.columns)
    assert a.exceptAll(b).count() == 0 and a.count() == 600
    sizes = {r.label: r.t for r in a.groupBy("label").agg(F.count_if("is_test").alias("t")).collect()}
    assert sizes == {"N": 108, "P1": 36, "P2": 18, "P3": 18}
    other = D.stratified_split(dataset, "label", keys, seed=1).select(a.columns)
    assert a.exceptAll(other).count() > 0
    assert D.stratified_split(dataset, "label", keys, 1.0).where("NOT is_test").count() == 0
    assert D.stratified_split(dataset, "label", keys, 0.0).where("is_test").count() == 0


def test_training_scoring_and_importance(spark, dataset):
    features = ["x", "y", "flat"]
    model = D.train_classifier(dataset, features, numTrees=10, maxDepth=5)
    scored = D.score(model, dataset, features)
    assert M.accuracy(scored).first().accuracy > 0.98
    importance = D.feature_importance(model, features)
    rows = importance.orderBy("position").collect()
    assert rows[0].feature == "x" and rows[-1].cumulative == pytest.approx(1.0)
    assert D.top_features(importance, 2).count() == 2
    scaled = D.scale(dataset, features)
    stats = scaled.agg(F.avg("x_scaled"), F.stddev_pop("x_scaled"), F.max("flat_scaled")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and stats[2] == 0.0


def test_learning_curve(dataset):
    rows = D.learning_curve(
        dataset, ["packet_number"], ["x", "y"], sizes=(0.2, 1.0), k=2, numTrees=3, maxDepth=4
    ).collect()
    assert len(rows) == 2 and all(0.8 < r.validation_mean <= 1.0 for r in rows)


def test_roc_equals_direct_computation(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 4, 500)
    p = np.round(rng.dirichlet(np.ones(4), 500), 2)
    rows = [(LABELS[t], *map(float, q)) for t, q in zip(y, p)]
    df = spark.createDataFrame(rows, "label string, prob_N double, prob_P1 double, prob_P2 double, prob_P3 double")
    auc = {r["class"]: r.auc for r in M.roc_auc(M.roc_points(df)).collect()}
    for i, name in enumerate(LABELS):
        pos, neg = p[y == i, i], p[y != i, i]
        pairs = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
        assert auc[name] == pytest.approx(pairs)


def test_metrics_with_missing_classes(spark):
    df = spark.createDataFrame([("N", "N"), ("N", "P1"), ("P1", "P1")], "label string, prediction string")
    report = {r.label: r for r in M.classification_report(df).collect()}
    assert report["P2"].precision == 0.0 and report["P2"].recall == 0.0 and report["P2"].support == 0
    assert report["N"].recall == 0.5 and report["P1"].precision == 0.5
    assert report["accuracy"].f1 == pytest.approx(2 / 3)
    assert {r.label: r.accuracy for r in M.class_accuracy(df).collect()} == {"N": 0.5, "P1": 1.0, "P2": 0.0, "P3": 0.0}
    c = {r.label: r for r in M.confusion(df).collect()}
    assert (c["N"].N, c["N"].P1, c["N"].N_share) == (1, 1, 0.5)
    empty = M.classification_report(df.where("false")).collect()
    assert all(r.support == 0 for r in empty)


def test_sessions_of_a_hot_key(spark):
    """Ties and slice borders inside and between sessions."""
    rng = np.random.default_rng(9)
    times = np.sort(rng.integers(0, 20_000, 600))
    rows = [(("h" if i % 3 else "c"), i, int(t), 1) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, packet_number long, s long, packet_length int")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(
        (r.k, int(r.session_start.timestamp()), r.packets)
        for r in T.sessions(df, ["k"], "60 seconds", hot_rows=20).collect()
    )
    want = []
    for k in ("c", "h"):
        last = None
        for name, _, s, _ in rows:
            if name != k:
                continue
            if last is None or s - last >= 60:
                want.append([k, s, 0])
            want[-1][2] += 1
            last = s
    assert got == sorted(map(tuple, want))


def test_label_table_function(spark):
    register(spark)
    rows = spark.sql(
        """SELECT t.* FROM VALUES ('{"a.pcap": {"packet_labels": [{"packet_number": 1, "label": "N"}]}}'),
           ('{"packet_labels": [{"packet_number": 2, "label": "P1"}]}') AS d(doc), LATERAL explode_labels(doc) t"""
    ).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == [("a.pcap", 1, "N"), (None, 2, "P1")]


def test_one_short_gap_is_no_burst(spark):
    """A burst reason needs ten short gaps in a row, also on packets that another pattern rule flags."""
    columns = "packet_length, time_delta_ms, payload_entropy, function_code_stability_10, is_burst, packet_number"
    values = "(60, 0.5D, 4.0D, 0.1D, false, 1L), (60, 0.5D, 4.0D, 0.1D, true, 2L), (60, 0.5D, 4.0D, 0.9D, true, 3L), (60, 5.0D, 4.0D, 0.1D, true, 4L)"
    fixed = "'c' capture_id, 3 function_code, 1 protocol_id_valid, 1 unit_id_valid, 1 length_consistent, 1 is_read_operation, 0 is_write_operation, 0 is_error_response"
    rows = spark.sql(f"SELECT *, {fixed} FROM VALUES {values} AS t({columns})")
    got = {r.packet_number: r.anomaly_reasons for r in R.flag_anomalies(rows).collect()}
    assert got == {1: [C.REASON_RAPID], 2: [C.REASON_BURST, C.REASON_RAPID], 3: [C.REASON_BURST], 4: [C.REASON_RAPID]}
