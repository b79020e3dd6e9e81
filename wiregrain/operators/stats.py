"""Summary, traffic and entropy statistics per capture or any other key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.operators.quantiles import quantile_table
from wiregrain.operators.spread import join_null_safe
from wiregrain.session import settle


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys, NULL ones included. Without keys ``right`` is one row, read as a scalar subquery."""
    if keys:
        return join_null_safe(left, right, keys)
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumns({c: row[c] for c in right.columns})


def share_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n`` per (keys, value) and its percentage of the key; the total runs over the counts only."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", F.col("n") / total * 100)


def function_code_distribution(df: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Count and percentage per function code with its name."""
    named = df.select(*keys, "function_code", "function_name")
    names = named.groupBy(*keys, "function_code").agg(
        F.count(F.lit(1)).alias("n"), F.first("function_name").alias("function_name")
    )
    total = (
        F.sum("n").over(Window.partitionBy(*keys)) if keys else names.agg(F.sum("n")).scalar()
    )
    return names.withColumn("percentage", F.col("n") / total * 100)


def entropy_statistics(
    df: DataFrame, column: str = "payload_entropy", keys: Sequence[str] = ()
) -> DataFrame:
    """Mean, population deviation, range, median and quartiles; zeros when there is no value."""
    df = settle(df.select(*keys, F.col(column).cast("double").alias(column)))
    basic = df.groupBy(*keys).agg(
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    wanted = {"median": (column, 0.5), "q25": (column, 0.25), "q75": (column, 0.75)}
    out = join_keys(basic, quantile_table(df, wanted, keys, stored=True), keys)
    return out.fillna(0.0, ["mean", "std", "min", "max", "median"])


def distinct_counts(df: DataFrame, columns: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Exact distinct counts of several columns at once, ``columns`` mapping column to output name.

    Several ``countDistinct`` in one aggregation copy every row once per column. Here
    the combinations are made distinct first, and only those few are copied.
    """
    combos = df.select(*keys, *columns).distinct()
    return combos.groupBy(*keys).agg(*[F.countDistinct(c).alias(name) for c, name in columns.items()])


def _zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def summary_statistics(features: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """One wide row per key. With ``keys=()`` an empty input gives one row of zeros.

    Timing is in milliseconds; deviations of length and timing are sample ones,
    those of entropy are population ones.
    """
    # Read by three jobs below, so windows and entropies are computed once.
    features = settle(features.select(*keys, *_SUMMARY_COLUMNS))
    unique = distinct_counts(
        features,
        {
            "function_code": "unique_function_codes",
            "src_ip": "unique_src_ips",
            "dst_ip": "unique_dst_ips",
            "unit_id": "unique_unit_ids",
        },
        keys,
    )
    ms = F.col("time_delta_ms")
    out = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_packets"),
        _zero(F.avg("packet_length")).alias("length_mean"),
        _zero(F.stddev_samp("packet_length")).alias("length_std"),
        F.coalesce(F.min("packet_length"), F.lit(0)).alias("length_min"),
        F.coalesce(F.max("packet_length"), F.lit(0)).alias("length_max"),
        _zero(F.stddev_samp("packet_length") / F.nullif(F.avg("packet_length"), F.lit(0.0))).alias(
            "length_cv"
        ),
        _zero(F.avg(ms)).alias("iat_mean_ms"),
        _zero(F.stddev_samp(ms)).alias("iat_std_ms"),
        _zero(F.min(ms)).alias("iat_min_ms"),
        _zero(F.max(ms)).alias("iat_max_ms"),
        _zero(F.when(F.avg(ms) > 0, F.stddev_samp(ms) / F.avg(ms))).alias("iat_cv"),
        _zero(F.avg("payload_entropy")).alias("payload_entropy_mean"),
        _zero(F.stddev_pop("payload_entropy")).alias("payload_entropy_std"),
        _zero(F.min("payload_entropy")).alias("payload_entropy_min"),
        _zero(F.max("payload_entropy")).alias("payload_entropy_max"),
        _zero(F.avg("header_entropy")).alias("header_entropy_mean"),
        _zero(F.stddev_pop("header_entropy")).alias("header_entropy_std"),
        _zero(F.min("header_entropy")).alias("header_entropy_min"),
        _zero(F.max("header_entropy")).alias("header_entropy_max"),
        _zero(F.avg(F.col("is_normal_entropy").cast("int")) * 100).alias("normal_entropy_pct"),
        F.coalesce(F.sum("is_read_operation"), F.lit(0)).alias("read_count"),
        F.coalesce(F.sum("is_write_operation"), F.lit(0)).alias("write_count"),
        F.coalesce(F.sum("is_error_response"), F.lit(0)).alias("error_count"),
        _zero(F.avg("is_read_operation") * 100).alias("read_pct"),
        _zero(F.avg("is_write_operation") * 100).alias("write_pct"),
        _zero(F.avg("is_error_response") * 100).alias("error_pct"),
        F.count_if("is_valid").alias("valid_packets"),
        F.count_if(~F.col("is_valid")).alias("invalid_packets"),
        _zero(F.avg(F.col("is_valid").cast("int")) * 100).alias("validity_rate"),
    )
    wanted = {
        "length_median": ("packet_length", 0.5),
        "iat_median_ms": ("time_delta_ms", 0.5),
        "payload_entropy_median": ("payload_entropy", 0.5),
        "payload_entropy_q25": ("payload_entropy", 0.25),
        "payload_entropy_q75": ("payload_entropy", 0.75),
        "header_entropy_median": ("header_entropy", 0.5),
        "header_entropy_q25": ("header_entropy", 0.25),
        "header_entropy_q75": ("header_entropy", 0.75),
    }
    medians = quantile_table(features, wanted, keys, stored=True)
    return join_keys(join_keys(out, unique, keys), medians, keys).fillna(0.0, list(wanted))


_SUMMARY_COLUMNS = [
    "packet_length",
    "time_delta_ms",
    "payload_entropy",
    "header_entropy",
    "is_normal_entropy",
    "function_code",
    "src_ip",
    "dst_ip",
    "unit_id",
    "is_read_operation",
    "is_write_operation",
    "is_error_response",
    "is_valid",
]


def distribution_map(df: DataFrame, column: str, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Counts of a code column as one map per key. Codes and unit ids are at most 16 bits, so the map is bounded."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(column, "n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(f"{column}_distribution"))


def summary_report(features: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Summary statistics with the function-code and unit distributions as maps."""
    out = summary_statistics(features, keys)
    for column in ("function_code", "unit_id"):
        out = join_keys(out, distribution_map(features, column, keys), keys)
    return out


def most_common_code(df: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Most frequent function code (smallest on ties), its count, its percentage of all rows, and code diversity."""
    counts = df.groupBy(*keys, "function_code").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("function_code").isNotNull(), F.struct("n", (-F.col("function_code")).alias("col2"))))
    return counts.groupBy(*keys).agg(
        (-best["col2"]).alias("top_code"),
        best["n"].alias("top_count"),
        (best["n"] / F.sum("n") * 100).alias("top_percentage"),
        F.count("function_code").alias("function_diversity"),
    )


def traffic_statistics(features: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Duration, packet rate, size consistency, read/write ratio and the dominant function code."""
    seconds = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    std = F.stddev_samp("packet_length")
    basic = features.groupBy(*keys).agg(
        seconds.alias("total_duration_seconds"),
        (F.count(F.lit(1)) / F.greatest(seconds, F.lit(1.0))).alias("packet_per_second"),
        (F.avg("time_delta") * 1000).alias("avg_inter_arrival_ms"),
        F.avg("packet_length").alias("avg_packet_size"),
        std.alias("size_variability"),
        F.when(std < 50, "consistent").otherwise("variable").alias("size_consistency"),
        (
            F.sum("is_read_operation") / F.greatest(F.sum("is_write_operation"), F.lit(1))
        ).alias("read_write_ratio"),
    )
    return join_keys(basic, most_common_code(features, keys), keys)


def analysis_report(features: DataFrame) -> DataFrame:
    """Headline numbers as rows ``(section, position, metric, value)``."""
    traffic = traffic_statistics(features, ()).alias("t")
    names = {"src_ip": "unique_sources", "dst_ip": "unique_destinations", "unit_id": "unique_unit_ids"}
    total = features.agg(F.count(F.lit(1)).alias("total_packets"))
    network = join_keys(total, distinct_counts(features, names, ()), ())
    wide = settle(join_keys(traffic, network, ()))
    lines = [
        ("Executive Summary", "total_packets"),
        ("Executive Summary", "packet_per_second"),
        ("Traffic Characteristics", "avg_packet_size"),
        ("Traffic Characteristics", "size_consistency"),
        ("Traffic Characteristics", "read_write_ratio"),
        ("Protocol Usage", "function_diversity"),
        ("Protocol Usage", "top_code"),
        ("Protocol Usage", "top_percentage"),
        ("Network Topology", "unique_sources"),
        ("Network Topology", "unique_destinations"),
        ("Network Topology", "unique_unit_ids"),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                F.lit(i).alias("position"),
                F.lit(metric).alias("metric"),
                _text(wide, metric).alias("value"),
            )
            for i, (section, metric) in enumerate(lines)
        ]
    )
    head = wide.select(F.inline(entries))
    codes = share_counts(features, (), "function_code").select(
        F.lit("Detailed Function Code Distribution").alias("section"),
        (F.lit(1000) + F.col("function_code")).alias("position"),
        F.concat(F.lit("code_"), F.col("function_code").cast("string")).alias("metric"),
        F.format_string("%d packets (%.1f%%)", "n", "percentage").alias("value"),
    )
    return head.unionByName(codes)


def _text(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.format_string("%.4f", column) if kind == "double" else F.col(column).cast("string")


def report_markdown(report: DataFrame) -> str:
    """Markdown of an ``analysis_report``: at most eleven lines plus one per function code."""
    lines, section = ["# Traffic Analysis Report"], None
    for row in report.orderBy("position").collect():
        if row["section"] != section:
            section = row["section"]
            lines += ["", f"## {section}"]
        lines.append(f"- **{row['metric']}**: {row['value']}")
    return "\n".join(lines) + "\n"
