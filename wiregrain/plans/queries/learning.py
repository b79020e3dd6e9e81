"""Classifier metrics, splits, scaling, scoring and what scored captures say."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain.operators import detect as D
from wiregrain.operators import inference as I
from wiregrain.operators import metrics as M
from wiregrain.operators.labels import KEYS
from wiregrain.operators.spread import dense_index
from wiregrain.plans.queries.registry import query, tidy
from wiregrain.plans.tables import modbus_packets, scored_events, table

_SCORED = """sc AS (
  SELECT strftime(ts, '%Y-%m-%d') AS capture_id, event_id AS packet_number, epoch_us(ts) AS us, event_type AS protocol, user_id % 4 AS y,
    CASE WHEN event_id % 7 >= 5 THEN (user_id % 4 + 1 + event_id % 3) % 4 ELSE user_id % 4 END AS g, 0.5 + (event_id * 37 % 50) / 100 AS confidence
  FROM events),
lb AS (SELECT unnest(['N', 'P1', 'P2', 'P3']) AS label, unnest([0, 1, 2, 3]) AS k),
s AS (SELECT sc.*, a.label, b.label AS prediction FROM sc JOIN lb a ON a.k = y JOIN lb b ON b.k = g)"""


@query("accuracy", f"WITH {_SCORED} SELECT count(*) AS n, round(avg(CAST(y = g AS INTEGER)), 6) AS accuracy FROM s")
def accuracy(spark, folder):
    return tidy(M.accuracy(scored_events(spark, folder)))


@query(
    "confusion",
    f"WITH {_SCORED} SELECT label, "
    + ", ".join(
        f"count(*) FILTER (prediction = '{c}') AS {c}, round(count(*) FILTER (prediction = '{c}') / count(*), 6) AS {c}_share"
        for c in ("N", "P1", "P2", "P3")
    )
    + " FROM s GROUP BY label",
)
def confusion(spark, folder):
    return tidy(M.confusion(scored_events(spark, folder)))


@query(
    "class_report",
    f"""WITH {_SCORED},
c AS (SELECT k, lb.label, (SELECT count(*) FROM s WHERE y = k AND g = k) AS h, (SELECT count(*) FROM s WHERE g = k) AS p, (SELECT count(*) FROM s WHERE y = k) AS u FROM lb),
r AS (SELECT k AS position, label, h / p AS precision, h / u AS recall, 2 * h / (p + u) AS f1, u AS support, h FROM c)
SELECT position, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 100, 'accuracy', round(sum(h) / sum(support), 6), round(sum(h) / sum(support), 6), round(sum(h) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 101, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 102, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""",
)
def class_report(spark, folder):
    return tidy(M.classification_report(scored_events(spark, folder)))


@query(
    "class_accuracy",
    f"WITH {_SCORED} SELECT label, count(*) AS support, round(avg(CAST(y = g AS INTEGER)), 6) AS accuracy FROM s GROUP BY label",
)
def class_accuracy(spark, folder):
    return tidy(M.class_accuracy(scored_events(spark, folder)))


@query(
    "per_group_accuracy",
    f"""WITH {_SCORED} SELECT protocol, 'all' AS label, count(*) AS support, round(avg(CAST(y = g AS INTEGER)), 6) AS accuracy FROM s GROUP BY protocol
UNION ALL SELECT protocol, label, count(*), round(avg(CAST(y = g AS INTEGER)), 6) FROM s GROUP BY protocol, label""",
)
def per_group_accuracy(spark, folder):
    return tidy(M.protocol_accuracy(scored_events(spark, folder)))


_ROC = f"""{_SCORED},
l AS (SELECT lb.label AS class, CASE WHEN g = k THEN confidence ELSE (1 - confidence) / 3 END AS score, CAST(y = k AS INTEGER) AS hit FROM s, lb),
st AS (SELECT class, score, sum(hit) AS pos, count(*) - sum(hit) AS neg FROM l GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an
  FROM st WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "roc_points",
    f"WITH {_ROC} SELECT class, round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr FROM cu",
)
def roc_points(spark, folder):
    points = M.roc_points(scored_events(spark, folder))
    return tidy(points.select("class", "threshold", "tp", "fp", "tpr", "fpr"))


@query("roc_auc", f"WITH {_ROC} SELECT class, round(sum(neg * (tp - pos / 2)) / (any_value(ap) * any_value(an)), 6) AS auc FROM cu GROUP BY class")
def roc_auc(spark, folder):
    return tidy(M.roc_auc(M.roc_points(scored_events(spark, folder))))


@query(
    "detection_quality",
    f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (y > 0 AND g > 0) AS tp, count(*) FILTER (y = 0 AND g > 0) AS fp, count(*) FILTER (y > 0 AND g = 0) AS fn, count(*) FILTER (y = 0 AND g = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(fp / (fp + tn), 6) AS false_positive_rate, (tp + tn) / (tp + fp + fn + tn) > 0.9 AS meets_accuracy, fp / (fp + tn) < 0.05 AS meets_false_positive_rate FROM c""",
)
def detection_quality(spark, folder):
    return tidy(M.detection_quality(scored_events(spark, folder)))


@query(
    "stratified_split",
    f"WITH {_SCORED}, c AS (SELECT label, count(*) AS n FROM s GROUP BY label) SELECT label, CAST(round(n * 0.3) AS BIGINT) AS test, n - CAST(round(n * 0.3) AS BIGINT) AS train FROM c",
)
def stratified_split(spark, folder):
    """Sizes are exact; which rows are chosen is a hash of their keys."""
    parts = D.stratified_split(scored_events(spark, folder), "label", KEYS)
    return parts.groupBy("label").agg(
        F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train")
    )


@query(
    "standard_scale",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / d, 6) + 0.0 AS o_totalprice_scaled, 0.0::DOUBLE AS one_scaled FROM orders, s""",
)
def standard_scale(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.lit(1.0).alias("one"))
    return tidy(D.scale(orders, ["o_totalprice", "one"]).select("o_orderkey", "o_totalprice_scaled", "one_scaled"))


@query(
    "transitions",
    f"""WITH {_SCORED}, t AS (SELECT *, lag(prediction) OVER (PARTITION BY capture_id ORDER BY packet_number) AS from_label FROM s)
SELECT capture_id, packet_number, us AS ts, from_label, prediction AS to_label FROM t WHERE from_label <> prediction""",
)
def transitions(spark, folder):
    return tidy(I.transitions(scored_events(spark, folder)))


@query(
    "first_transitions",
    f"""WITH {_SCORED}, t AS (SELECT *, lag(prediction) OVER (PARTITION BY capture_id ORDER BY packet_number) AS from_label FROM s)
SELECT capture_id, packet_number, from_label, prediction AS to_label FROM t WHERE from_label <> prediction ORDER BY packet_number LIMIT 10""",
)
def first_transitions(spark, folder):
    """The report shows the first ten."""
    return I.first_transitions(I.transitions(scored_events(spark, folder))).drop("ts")


@query(
    "count_windows",
    f"""WITH {_SCORED}, i AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY packet_number) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS n FROM s),
z AS (SELECT *, greatest(100, n // 20) AS size FROM i),
w AS (SELECT z.*, unnest(range(0, n - size, size // 2)) AS start FROM z)
SELECT capture_id, start // (size // 2) AS window_number, count(*) AS packets, round(avg(us / 1e6), 3) AS center_time,
  round(avg(CAST(prediction <> 'N' AS INTEGER)), 6) AS attack_ratio, round(avg(confidence), 6) AS avg_confidence
FROM w WHERE i >= start AND i < start + size GROUP BY capture_id, start, size""",
)
def count_windows(spark, folder):
    scored = scored_events(spark, folder)
    rows = dense_index(scored, "position", keys=["capture_id"], order="packet_number")
    out = tidy(I.count_windows(rows, position="position"))
    return out.withColumn("center_time", F.round("center_time", 3))


@query(
    "confidence_histogram",
    f"""WITH {_SCORED}, e AS (SELECT prediction, min(confidence) AS lo, max(confidence) AS hi FROM s GROUP BY ALL),
x AS (SELECT prediction, confidence AS x, lo, hi, (hi - lo) / 30 AS step, least(CAST(floor((confidence - lo) * (30 / (hi - lo))) AS INTEGER), 29) AS g FROM s JOIN e USING (prediction)),
h AS (SELECT prediction, g - CAST(x < lo + g * step AS INTEGER) + CAST(x >= lo + (g + 1) * step AND g < 29 AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY ALL)
SELECT e.prediction, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * (hi - lo) / 30, 6) AS bin_lo, round(lo + (b.bin + 1) * (hi - lo) / 30, 6) AS bin_hi, coalesce(n, 0) AS n
FROM e CROSS JOIN (SELECT unnest(range(30)) AS bin) b LEFT JOIN h ON h.prediction = e.prediction AND h.bin = b.bin""",
)
def confidence_histogram(spark, folder):
    return tidy(I.confidence_histogram(scored_events(spark, folder)))


@query(
    "capture_verdicts",
    f"""WITH {_SCORED}, t AS (SELECT *, lag(prediction) OVER (PARTITION BY capture_id ORDER BY packet_number) AS b FROM s)
SELECT capture_id, count(*) AS packets, count(*) FILTER (g = 0) AS "packets_N", count(*) FILTER (g = 1) AS "packets_P1", count(*) FILTER (g = 2) AS "packets_P2", count(*) FILTER (g = 3) AS "packets_P3",
  round(avg(confidence), 6) AS mean_confidence, count(*) AS modbus_packets, count(*) AS tcp_packets, 0 AS udp_packets, CAST(count(*) FILTER (g > 0) > 0 AS INTEGER) AS attack_detected,
  concat_ws(', ', CASE WHEN count(*) FILTER (g = 0) > 0 THEN 'N' END, CASE WHEN count(*) FILTER (g = 1) > 0 THEN 'P1' END, CASE WHEN count(*) FILTER (g = 2) > 0 THEN 'P2' END, CASE WHEN count(*) FILTER (g = 3) > 0 THEN 'P3' END) AS labels_present,
  round(count(*) FILTER (g = 0) / count(*) * 100, 6) AS "pct_N", round(count(*) FILTER (g = 1) / count(*) * 100, 6) AS "pct_P1", round(count(*) FILTER (g = 2) / count(*) * 100, 6) AS "pct_P2", round(count(*) FILTER (g = 3) / count(*) * 100, 6) AS "pct_P3",
  count(*) FILTER (b <> prediction) AS transitions
FROM t GROUP BY capture_id""",
)
def capture_verdicts(spark, folder):
    return tidy(I.capture_verdicts(scored_events(spark, folder)))


def _labelled_packets(spark, folder):
    """Packet features with a label the features can explain: by unit and operation."""
    packets = modbus_packets(spark, folder)
    label = (
        F.when(F.col("mb_func_code") == 131, "P2")
        .when(F.col("mb_write_reg") == 1, "P1")
        .when(F.col("packet_size") > 200, "P3")
        .otherwise("N")
    )
    rows = D.packet_ml_features(packets).withColumn("label", label)
    number = F.when(F.col("label") == "N", 0).when(F.col("label") == "P1", 1)
    number = number.when(F.col("label") == "P2", 2).otherwise(3)
    return rows.withColumn("numeric_label", number)


# Smaller forests than the default, to keep the check short; rows are never reduced.
_SMALL = {"numTrees": 10, "maxDepth": 6}


@query("rf_score")
def rf_score(spark, folder):
    """Train on 70 %, score the rest: accuracy and mean confidence per true label."""
    from wiregrain.plans.analysis import train

    _, scored = train(_labelled_packets(spark, folder), **_SMALL)
    hit = (F.col("prediction") == F.col("label")).cast("int")
    return tidy(
        scored.groupBy("label").agg(
            F.count(F.lit(1)).alias("packets"),
            F.avg(hit).alias("accuracy"),
            F.avg("confidence").alias("mean_confidence"),
        ),
        3,
    )


@query("feature_importance")
def feature_importance(spark, folder):
    model = D.train_classifier(_labelled_packets(spark, folder), **_SMALL)
    return tidy(D.feature_importance(model), 3)


@query("learning_curve")
def learning_curve(spark, folder):
    rows = _labelled_packets(spark, folder)
    return tidy(D.learning_curve(rows, KEYS, sizes=(0.3, 1.0), k=2, numTrees=5, maxDepth=5), 3)
