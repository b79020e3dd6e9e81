"""Per-group statistics, frequency distributions and fingerprint comparison."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.functions.text import group_name
from wiregrain.operators.features import numeric_columns
from wiregrain.operators.quantiles import quantile_table
from wiregrain.session import settle

GROUP_COLUMNS = ("src_ip", "dst_ip", "unit_id")
_IDS = {"timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "function_name", "packet_number"}


def select_features(
    df: DataFrame, features: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> list[str]:
    """The given features, or every numeric or boolean column that is not an id."""
    return list(features) if features else numeric_columns(df, _IDS | set(keys))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"grouping column '{c}' not found")


def _grouped_input(
    df: DataFrame, keys: Sequence[str], features: Sequence[str] | None
) -> tuple[DataFrame, list[str]]:
    require_columns(df, keys)
    features = select_features(df, features, keys)
    rows = df.dropna(subset=list(keys)).select(
        *keys, *[F.col(f).cast("double").alias(f) for f in features if f not in keys]
    )
    return rows, [f for f in features if f not in keys]


def threshold_columns(
    df: DataFrame,
    features: Sequence[str],
    thresholds: Mapping[str, float] | float | None,
    stored: bool = False,
) -> dict[str, Column]:
    """Threshold of each feature: a scalar, a given value, or the exact median of the whole table."""
    if isinstance(thresholds, (int, float)):
        return {f: F.lit(float(thresholds)) for f in features}
    given = dict(thresholds or {})
    open_ = [f for f in features if f not in given]
    out = {f: F.lit(float(v)) for f, v in given.items() if f in features}
    if open_:
        medians = settle(quantile_table(df, {f: (f, 0.5) for f in open_}, stored=stored))
        out |= {f: medians.select(f).scalar() for f in open_}
    return out


def group_stats(
    df: DataFrame,
    keys: Sequence[str] = GROUP_COLUMNS,
    features: Sequence[str] | None = None,
    thresholds: Mapping[str, float] | float | None = None,
    stored: bool = False,
    with_thresholds: bool = False,
) -> DataFrame:
    """Mean, sample deviation, count and counts below and above the threshold, per group and feature.

    Medians are taken over all rows, those of no group included. ``stored`` is as in ``exact_quantiles``;
    ``with_thresholds`` adds the thresholds themselves.
    One hash aggregation: partial sums leave the map side, so a hot group is
    merged from one partial row per task.
    """
    rows, features = _grouped_input(df, keys, features)
    limits = threshold_columns(df, features, thresholds, stored)
    aggs = []
    for f in features:
        if with_thresholds:
            aggs.append(F.first(limits[f] if isinstance(limits[f], Column) else F.lit(float(limits[f]))).cast("double").alias(f"{f}_threshold"))
        aggs += [
            F.coalesce(F.avg(f), F.lit(0.0)).alias(f"{f}_mean"),
            F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_std"),
            F.count(f).alias(f"{f}_count"),
            F.count_if(F.col(f) < limits[f]).alias(f"{f}_count_below_threshold"),
            F.count_if(F.col(f) > limits[f]).alias(f"{f}_count_above_threshold"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


def frequency_distributions(
    df: DataFrame,
    keys: Sequence[str] = GROUP_COLUMNS,
    features: Sequence[str] | None = None,
    bins: int = 10,
    top_n: int = 10,
) -> DataFrame:
    """Long table of one distribution per group and feature.

    More than ``max(bins, top_n)`` distinct values make an equal-width histogram
    (``kind`` hist, last bin closed); otherwise the ``top_n`` most frequent values
    (``kind`` value_counts, ties by value); no value at all gives one ``empty`` row.

    Which case applies needs only "more than k distinct?", which a few values of each batch settle exactly.
    """
    rows, features = _grouped_input(df, keys, features)
    limit = max(bins, top_n)
    packed = rows.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.count(f).alias("total"),
                    F.min(f).alias("lo"),
                    F.max(f).alias("hi"),
                )
                for f in features
            ]
        ).alias("__s")
    )
    spans = settle(packed.select(*keys, F.inline("__s")))
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    long = rows.select(*keys, F.expr(f"stack({len(features)}, {pairs}) as (feature, x)"))
    long = long.where(F.col("x").isNotNull())
    held = settle(_distinct_up_to(long, [*keys, "feature"], limit + 1))
    long = long.join(spans, [*keys, "feature"]).join(held, [*keys, "feature"])
    few = F.col("distinct") <= limit
    counted = (
        long.withColumn("bin", histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
        .withColumn("value", F.when(few, F.col("x")))
        .groupBy(*keys, "feature", "total", "lo", "hi", "value", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy(*keys, "feature")
    listed = F.col("value").isNotNull()

    best = group.orderBy(F.col("n").desc(), "value")
    top = (
        counted.where(listed)
        .withColumn("position", F.row_number().over(best))
        .where(F.col("position") <= top_n)
        .select(
            *keys,
            "feature",
            F.lit("value_counts").alias("kind"),
            "position",
            F.lit(None).cast("double").alias("bin_lo"),
            F.lit(None).cast("double").alias("bin_hi"),
            "value",
            "n",
            (F.col("n") / F.col("total")).alias("share"),
            "total",
        )
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    filled = (
        counted.where(~listed)
        .groupBy(*keys, "feature", "total", "lo", "hi", "bin")
        .agg(F.sum("n").alias("n"))
    )
    shape = filled.select(*keys, "feature", "total", "lo", "hi").distinct().select("*", every)
    step = (F.col("hi") - F.col("lo")) / bins
    hist = shape.join(
        filled.select(*keys, "feature", "bin", "n"), [*keys, "feature", "bin"], "left"
    ).select(
        *keys,
        "feature",
        F.lit("hist").alias("kind"),
        (F.col("bin") + 1).alias("position"),
        (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * step)
        .alias("bin_hi"),
        F.lit(None).cast("double").alias("value"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"),
        "total",
    )
    nothing = spans.where(F.col("total") == 0).select(
        *keys,
        "feature",
        F.lit("empty").alias("kind"),
        F.lit(1).alias("position"),
        *[F.lit(None).cast("double").alias(c) for c in ("bin_lo", "bin_hi", "value")],
        F.lit(0).cast("long").alias("n"),
        F.lit(0.0).alias("share"),
        "total",
    )
    return top.unionByName(hist).unionByName(nothing)


def _distinct_up_to(long: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Per key the number of distinct ``x``, exact below ``most`` and else any number from ``most`` on.

    A batch passes on at most ``most`` values of a key. If it left some out, those passed on already make ``most``.
    """
    columns = [*keys, "x"]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(columns, use_threads=False).aggregate([]).select(columns)
            place = found.select(list(keys)).to_pandas().groupby(list(keys), sort=False, dropna=False).cumcount()
            yield from found.filter(pa.array(place.to_numpy() < most)).to_batches()

    # Adding zero makes -0.0 and 0.0 one value.
    rows = long.select(*keys, (F.col("x") + F.lit(0.0)).alias("x"))
    thinned = rows.mapInArrow(thin, rows.schema).distinct()
    return thinned.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"))


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Zero-based equal-width bin, the last one closed; a constant series is bin 0.

    After the division the guess is moved by one where it disagrees with the bin
    edges, so a value on an edge always counts to the bin that starts there.
    """
    step = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) * (bins / (hi - lo))), F.lit(bins - 1)).cast("int")
    down = (x < lo + guess * step).cast("int")
    up = ((x >= lo + (guess + 1) * step) & (guess < bins - 1)).cast("int")
    return F.when(hi > lo, guess - down + up).otherwise(0)


def distribution_document(distributions: DataFrame, keys: Sequence[str] = GROUP_COLUMNS) -> DataFrame:
    """One row per group and feature: the group name and the distribution as a bounded array."""
    entry = F.struct("position", "kind", "bin_lo", "bin_hi", "value", "n", "share")
    return distributions.groupBy(*keys, "feature").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(entry)).alias("dist")
    ).select(group_name(*keys).alias("group"), "feature", "total", "dist")


def stats_long(stats: DataFrame, keys: Sequence[str] = GROUP_COLUMNS) -> DataFrame:
    """``group_stats`` as rows ``(keys..., feature, mean, std, n, threshold, count_below, count_above)``."""
    features = [c[: -len("_count_below_threshold")] for c in stats.columns if c.endswith("_count_below_threshold")]
    limit = lambda f: f"`{f}_threshold`" if f"{f}_threshold" in stats.columns else "cast(NULL AS double)"
    parts = ", ".join(
        f"'{f}', `{f}_mean`, `{f}_std`, `{f}_count`, {limit(f)}, `{f}_count_below_threshold`, `{f}_count_above_threshold`"
        for f in features
    )
    names = "feature, mean, std, n, threshold, count_below, count_above"
    return stats.select(*keys, F.expr(f"stack({len(features)}, {parts}) as ({names})"))


def compare_fingerprints(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = GROUP_COLUMNS
) -> DataFrame:
    """Full outer join of two long fingerprints with deltas and where a group is missing."""
    on = [*keys, "feature"]
    a = left.select(*on, *[F.col(c).alias(f"{c}_left") for c in ("mean", "std", "n")])
    b = right.select(*on, *[F.col(c).alias(f"{c}_right") for c in ("mean", "std", "n")])
    return a.join(b, on, "full").select(
        *on,
        "mean_left",
        "mean_right",
        "n_left",
        "n_right",
        (F.col("mean_right") - F.col("mean_left")).alias("mean_delta"),
        (F.col("std_right") - F.col("std_left")).alias("std_delta"),
        F.when(F.col("n_left").isNull(), "only_right")
        .when(F.col("n_right").isNull(), "only_left")
        .otherwise("both")
        .alias("presence"),
    )
