"""Attack-event analytics: breakdowns, attribution, register ranges, timing and detection matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wiregrain.constants import ADDRESS_POOLS, SAFE_RANGES
from wiregrain.functions.text import last_octet, parse_iso, short_label
from wiregrain.operators.quantiles import quantile_table
from wiregrain.operators.spread import HOT_ROWS, SLICE, find_hot, ordered, running_sum, with_slice
from wiregrain.operators.stats import join_keys
from wiregrain.session import settle


def count_by(events: DataFrame, column: str) -> DataFrame:
    """Events per profile, category or any other column."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def function_code_usage(events: DataFrame, fc: str = "modbus_fc_used") -> DataFrame:
    """Function-code counts per profile and in total (``profile`` NULL), from one pass."""
    code, profile = F.concat(F.lit("FC_"), F.col(fc).cast("string")), "attacker_profile_id"
    rows = events.select(profile, code.alias("fc_name"))
    return rows.groupingSets(
        [[F.col(profile), F.col("fc_name")], [F.col("fc_name")]], F.col(profile), F.col("fc_name")
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping(profile).cast("int").alias("is_total"))


def attribution_violation(pools: Mapping[str, tuple[int, int]] = ADDRESS_POOLS) -> Column:
    """Source address outside the pool of its profile; an unknown profile or unreadable octet also counts."""
    octet, profile = last_octet(F.col("source_ip")), F.col("attacker_profile_id")
    inside = F.lit(False)
    for name, (low, high) in pools.items():
        inside = inside | ((profile == name) & octet.between(low, high))
    return ~F.coalesce(inside, F.lit(False))


def attribution_violations(
    events: DataFrame, pools: Mapping[str, tuple[int, int]] = ADDRESS_POOLS
) -> DataFrame:
    return events.where(attribution_violation(pools)).select(
        short_label(F.col("attacker_profile_id")).alias("profile"),
        F.col("source_ip").alias("ip"),
        "transaction_id",
        "timestamp_utc",
    )


def attribution_compliance(
    events: DataFrame,
    keys: Sequence[str] = (),
    pools: Mapping[str, tuple[int, int]] = ADDRESS_POOLS,
) -> DataFrame:
    """Checked events, violations and compliance rate in percent (0 when there are none)."""
    total, bad = F.count(F.lit(1)), F.count_if(attribution_violation(pools))
    rate = F.coalesce((total - bad) / F.nullif(total, F.lit(0)) * 100, F.lit(0.0))
    return events.groupBy(*keys).agg(
        total.alias("total_checked"), bad.alias("violations_found"), rate.alias("compliance_rate")
    )


def range_violation(
    register: Column, value: Column, ranges: Mapping[int, tuple[int, int]] = SAFE_RANGES
) -> Column:
    """Value outside the safe range of its register; registers without a range never violate."""
    out = F
    for number, (low, high) in ranges.items():
        out = out.when(register == number, ~value.between(low, high))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def range_violations(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same check against a ``(register, low, high)`` table such as the process-model file gives."""
    joined = events.join(
        ranges, F.col("target_register_address") == F.col("register"), "left"
    )
    outside = ~F.col("injected_value").between(F.col("low"), F.col("high"))
    return joined.withColumn("violates", F.coalesce(outside, F.lit(False)))


def process_check(
    events: DataFrame, ranges: Mapping[int, tuple[int, int]] = SAFE_RANGES
) -> DataFrame:
    """Integrity events, range violations among them, their rate, and the attribution verdict."""
    integrity = F.col("attack_category") == "Integrity"
    bad = integrity & range_violation(
        F.col("target_register_address"), F.col("injected_value"), ranges
    )
    n, hits = F.count_if(integrity), F.count_if(bad)
    return events.agg(
        n.alias("integrity_events"),
        hits.alias("violations"),
        (hits > 0).alias("process_violation"),
        F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("process_violation_rate"),
        (F.count_if(attribution_violation()) == 0).alias("attribution_contract"),
    )


def with_event_time(events: DataFrame) -> DataFrame:
    """Parsed ``ts`` next to the ISO text."""
    return events.withColumn("ts", parse_iso(F.col("timestamp_utc")))


def event_intervals(
    events: DataFrame, keys: Sequence[str], ties: Sequence[str] = (), hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Seconds to the previous event of the key in time order."""
    timed = events.withColumn("__us", F.unix_micros("ts"))

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        gap = (F.col("__us") - F.lag("__us").over(w)) / 1e6
        return rows.withColumn("interval_seconds", gap)

    return ordered(
        timed, compute, keys=keys, order="__us", ties=ties, depth=1, hot_rows=hot_rows
    ).drop("__us")


def temporal_pattern(
    events: DataFrame, keys: Sequence[str], ties: Sequence[str] = (), hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """First, last, duration and interval statistics per key; keys with fewer than two events drop out."""
    gaps = event_intervals(events, keys, ties, hot_rows)
    gaps = settle(gaps.select(*keys, "ts", "interval_seconds"))
    gap = F.col("interval_seconds")
    basic = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_attack"),
        F.max("ts").alias("last_attack"),
        F.avg(gap).alias("mean_interval_seconds"),
        F.stddev_pop(gap).alias("std_interval_seconds"),
        F.min(gap).alias("min_interval_seconds"),
        F.max(gap).alias("max_interval_seconds"),
    )
    seconds = (F.unix_micros("last_attack") - F.unix_micros("first_attack")) / 1e6
    basic = basic.where(F.col("events") >= 2).withColumn("total_duration_seconds", seconds)
    medians = quantile_table(gaps, {"median_interval_seconds": ("interval_seconds", 0.5)}, keys, stored=True)
    return join_keys(basic, medians, keys)


def match_detections(
    predictions: DataFrame,
    events: DataFrame,
    tolerance_seconds: float = 1.0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per attack event: packets of its capture predicted as its class within the tolerance.

    No pairs are formed. Every event asks a running packet count twice, just before
    its interval and at its end, and the difference is the number of packets inside.
    The running count works on slices of time that are cut until they are small, so a busy capture, or a flood within
    one second, is many windows.
    """
    tolerance = int(tolerance_seconds * 1e6)
    group = ["capture_id", "label"]
    wanted = events.withColumn("label", short_label(F.col("attacker_profile_id")))
    seen = (
        predictions.where(F.col("prediction") != "N")
        .groupBy("capture_id", F.col("prediction").alias("label"), F.unix_micros("ts").alias("us"))
        .agg(F.count(F.lit(1)).alias("packets"))
        .select(*group, "us", "packets", F.lit(0).alias("sign"), F.lit(None).cast("long").alias("event_id"))
    )
    at = F.unix_micros("ts")
    ends = F.array(
        F.struct((at - tolerance - 1).alias("us"), F.lit(-1).alias("sign")),
        F.struct((at + tolerance).alias("us"), F.lit(1).alias("sign")),
    )
    probes = wanted.select(*group, "event_id", F.inline(ends)).withColumn(
        "packets", F.lit(0).cast("long")
    )
    points = settle(seen.unionByName(probes))
    points = with_slice(points, find_hot(points, group, "us", hot_rows))
    # Packets sort before probes of the same microsecond.
    order = [F.col("us"), F.col("sign") != 0]
    counted = running_sum(points, {"packets": "upto"}, keys=group, bucket=SLICE, order=order)
    hits = counted.where(F.col("sign") != 0).groupBy("capture_id", "event_id").agg(
        F.sum(F.col("sign") * F.col("upto")).alias("detected_packets")
    )
    return wanted.join(hits, ["capture_id", "event_id"], "left").select(
        "capture_id",
        "event_id",
        "label",
        F.coalesce("detected_packets", F.lit(0)).cast("long").alias("detected_packets"),
        F.coalesce(F.col("detected_packets") > 0, F.lit(False)).alias("detected"),
    )
