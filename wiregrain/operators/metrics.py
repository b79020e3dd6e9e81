"""Classifier metrics as aggregations over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrain.constants import LABELS
from wiregrain.operators.spread import HOT_ROWS, SLICE, find_hot, running_sum, with_slice
from wiregrain.session import settle


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"),
    )


def confusion(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    labels: Sequence[str] = tuple(LABELS),
) -> DataFrame:
    """Counts per true and predicted label, one column per predicted label, and their row shares."""
    counts = df.groupBy(label).pivot(prediction, list(labels)).count().fillna(0, list(labels))
    total = sum((F.col(c) for c in labels), F.lit(0))
    return counts.withColumns({f"{c}_share": _ratio(F.col(c), total) for c in labels})


def _class_counts(
    df: DataFrame, label: str, prediction: str, labels: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Per class: hits, predicted rows, true rows, and all rows; at most one row per class and key."""
    y, p = F.col(label), F.col(prediction)
    cells = df.groupBy(*keys, y.alias("__y"), p.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    y, p, c = F.col("__y"), F.col("__p"), F.col("__c")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, c)), F.lit(0))

    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("label"),
                total((y == name) & (p == name)).alias("hits"),
                total(p == name).alias("predicted"),
                total(y == name).alias("support"),
                F.coalesce(F.sum(c), F.lit(0)).alias("rows"),
            )
            for i, name in enumerate(labels)
        ]
    )
    return cells.groupBy(*keys).agg(entries.alias("__e")).select(*keys, F.inline("__e"))


def classification_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    labels: Sequence[str] = tuple(LABELS),
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    counts = _class_counts(df, label, prediction, labels)
    per_class = counts.select(
        "position",
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
        "rows",
    )
    measures = ("precision", "recall", "f1")
    whole = per_class.agg(
        F.sum("support").alias("support"),
        _ratio(F.sum("hits"), F.max("rows")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )
    lines = F.array(
        F.struct(
            F.lit(100).alias("position"),
            F.lit("accuracy").alias("label"),
            *[F.col("accuracy").alias(m) for m in measures],
            "support",
        ),
        *[
            F.struct(
                F.lit(101 + i).alias("position"),
                F.lit(f"{kind} avg").alias("label"),
                *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                F.col("support"),
            )
            for i, kind in enumerate(("macro", "weighted"))
        ],
    )
    return per_class.drop("hits", "rows").unionByName(whole.select(F.inline(lines)))


def class_accuracy(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    keys: Sequence[str] = (),
    labels: Sequence[str] = tuple(LABELS),
) -> DataFrame:
    """Share of each class that was predicted right (0 for an absent class), per key if given."""
    counts = _class_counts(df, label, prediction, labels, keys)
    return counts.select(
        *keys, "label", "support", _ratio(F.col("hits"), F.col("support")).alias("accuracy")
    )


def protocol_accuracy(
    df: DataFrame,
    protocol: str = "protocol",
    label: str = "label",
    prediction: str = "prediction",
    labels: Sequence[str] = tuple(LABELS),
) -> DataFrame:
    """Overall accuracy (``label`` 'all') and accuracy per class, for each protocol."""
    counts = _class_counts(df, label, prediction, labels, [protocol])
    overall = counts.groupBy(protocol).agg(
        F.lit("all").alias("label"),
        F.max("rows").alias("support"),
        _ratio(F.sum("hits"), F.max("rows")).alias("accuracy"),
    )
    per_class = counts.select(
        protocol, "label", "support", _ratio(F.col("hits"), F.col("support")).alias("accuracy")
    )
    return overall.unionByName(per_class)


#: Scores as whole numbers of this fraction, fine enough for doubles next to 1.
_SCORE_STEPS = 1 << 52


def score_slices(steps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Descending scores of each class in slices that follow the data: a class above the limit is cut until its slices are small."""
    steps = steps.withColumn("__place", F.floor((1 - F.col("score")) * _SCORE_STEPS).cast("long"))
    return with_slice(steps, find_hot(steps, ["class"], "__place", hot_rows)).drop("__place")


def roc_points(
    df: DataFrame,
    label: str = "label",
    labels: Sequence[str] = tuple(LABELS),
    prefix: str = "prob_",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One-vs-rest points, one per distinct score of each class: threshold, false and true positive rate.

    Ties are collapsed first; the descending running counts then work on slices of scores, not on one long sort.
    """
    pairs = ", ".join(f"'{c}', cast(`{prefix}{c}` as double)" for c in labels)
    long = df.select(F.col(label).alias("__y"), F.expr(f"stack({len(labels)}, {pairs}) as (class, score)"))
    hit = (F.col("__y") == F.col("class")).cast("long")
    # Read three times; scoring behind it runs once.
    steps = settle(
        long.groupBy("class", "score").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )
    ran = running_sum(
        score_slices(steps, hot_rows),
        {"pos": "tp", "neg": "fp"},
        keys=["class"],
        bucket=SLICE,
        order=[F.col("score").desc_nulls_first()],
    )
    totals = steps.groupBy("class").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # One row per class.
    return ran.join(F.broadcast(totals), "class").select(
        "class",
        F.col("score").alias("threshold"),
        "pos",
        "neg",
        "tp",
        "fp",
        _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"),
        _ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        "all_pos",
        "all_neg",
    )


def roc_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area per class, straight from the steps; NULL when a side is missing."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    size = F.max("all_pos") * F.max("all_neg")
    return points.groupBy("class").agg((area / F.nullif(size, F.lit(0))).alias("auc"))


def detection_quality(
    df: DataFrame, label: str = "label", prediction: str = "prediction", normal: str = "N"
) -> DataFrame:
    """Attack-or-normal view: accuracy, precision, recall, F1 and false-positive rate with their targets."""
    attack, alarm = F.col(label) != normal, F.col(prediction) != normal
    counts = df.agg(
        F.count_if(attack & alarm).alias("tp"),
        F.count_if(~attack & alarm).alias("fp"),
        F.count_if(attack & ~alarm).alias("fn"),
        F.count_if(~attack & ~alarm).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": _ratio(fp, fp + tn),
        }
    )
    return out.withColumns(
        {
            "meets_accuracy": F.col("accuracy") > 0.9,
            "meets_false_positive_rate": F.col("false_positive_rate") < 0.05,
        }
    )
