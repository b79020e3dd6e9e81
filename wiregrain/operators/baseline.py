"""Baseline thresholds per unit, and compliance with the normal-traffic criteria."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain import constants as C
from wiregrain.operators.flows import (
    MESSAGE_KEYS,
    iat_autocorrelation,
    iat_shape,
    modbus_messages,
    pair_requests,
    transaction_steps,
)
from wiregrain.operators.quantiles import quantile_table
from wiregrain.operators.spread import join_null_safe
from wiregrain.operators.stats import distinct_counts, most_common_code
from wiregrain.session import settle


def build_baseline(
    features: DataFrame,
    columns: Sequence[str] = ("packet_length", "payload_entropy", "time_delta_ms"),
    unit: str = "unit_id",
    min_packets: int = C.MIN_PACKETS_PER_UNIT,
) -> DataFrame:
    """Mean plus and minus two deviations per unit, for units with enough packets."""
    aggs = [F.count(F.lit(1)).alias("packets")]
    for c in columns:
        mean, margin = F.avg(c), C.SIGMA * F.stddev_samp(c)
        aggs += [(mean - margin).alias(f"{c}_low"), (mean + margin).alias(f"{c}_high")]
    return features.groupBy(unit).agg(*aggs).where(F.col("packets") >= min_packets)


def usual_codes(
    features: DataFrame, unit: str = "unit_id", min_rows: int = C.MIN_FUNCTION_CODE_ROWS
) -> DataFrame:
    """Function codes each unit uses often enough to count as normal."""
    counts = features.groupBy(unit, "function_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_rows)


def baseline_coverage(
    features: DataFrame, baseline: DataFrame, column: str = "packet_length", unit: str = "unit_id"
) -> DataFrame:
    """Share of a unit's packets inside its thresholds."""
    inside = F.col(column).between(F.col(f"{column}_low"), F.col(f"{column}_high"))
    counts = features.join(baseline.select(unit, f"{column}_low", f"{column}_high"), unit)
    return counts.groupBy(unit).agg(
        F.count(F.lit(1)).alias("packets"), F.avg(inside.cast("int")).alias("coverage")
    )


def observed_metrics(features: DataFrame) -> DataFrame:
    """One row per capture with every metric the criteria name."""
    key = ["capture_id"]
    # Four aggregations read these columns.
    features = settle(
        features.select(
            *key,
            "packet_number",
            "ts",
            "packet_length",
            "payload_entropy",
            "header_entropy",
            "full_packet_entropy",
            "function_code",
            "function_code_changes",
            "function_code_stability_10",
            "is_error_response",
            "src_ip",
            "dst_ip",
            "unit_id",
        )
    )
    basic = features.groupBy(*key).agg(
        F.avg("packet_length").alias("length_mean"),
        F.stddev_samp("packet_length").alias("length_std"),
        F.min("packet_length").cast("double").alias("length_min"),
        F.max("packet_length").cast("double").alias("length_max"),
        (F.stddev_samp("packet_length") / F.nullif(F.avg("packet_length"), F.lit(0.0))).alias("length_cv"),
        F.avg("payload_entropy").alias("payload_entropy_mean"),
        F.avg("header_entropy").alias("header_entropy_mean"),
        F.avg("full_packet_entropy").alias("full_packet_entropy_mean"),
        F.avg("function_code_changes").alias("fc_change_share"),
        F.avg("function_code_stability_10").alias("fc_stability"),
        *[
            (F.count_if(F.col("function_code") == c) / F.count(F.lit(1))).alias(f"fc_{c}_share")
            for c in (3, 16)
        ],
        F.avg("is_error_response").alias("error_share"),
    )
    sides = {"src_ip": "unique_src_ips", "dst_ip": "unique_dst_ips", "unit_id": "unique_unit_ids"}
    basic = basic.join(distinct_counts(features, sides, key), key)
    codes = most_common_code(features, key).select(
        *key,
        F.col("function_diversity").cast("double").alias("function_codes"),
        (F.col("top_percentage") / 100).alias("dominant_fc_share"),
    )
    return basic.join(iat_shape(features, key), key, "left").join(codes, key, "left")


def message_metrics(features: DataFrame, port: int) -> DataFrame:
    """One row per capture with the observed value of every message, flow and collection criterion.

    A flow is a pair of addresses in either direction; packets to ``port`` are requests, packets from it answers.
    Flows are aggregated first, so a capture is merged from one row per flow.
    """
    asks, answers = F.col("dst_port") == port, F.col("src_port") == port
    ends = [F.least("src_ip", "dst_ip").alias("end_a"), F.greatest("src_ip", "dst_ip").alias("end_b")]
    flows = features.groupBy("capture_id", *ends).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("protocol_id_valid", "unit_id_valid", "length_consistent")],
        F.count_if(F.col("function_code").isin(*C.STANDARD_CODES)).alias("standard"),
        F.count_if(asks).alias("asks"),
        F.count_if(answers).alias("answers"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    seconds = lambda first, last: (F.unix_micros(last) - F.unix_micros(first)) / 1e6
    share = lambda c: F.sum(c) / F.sum("n")
    return flows.groupBy("capture_id").agg(
        share("protocol_id_valid").alias("protocol_id_share"),
        share("unit_id_valid").alias("unit_id_share"),
        share("length_consistent").alias("length_share"),
        share("standard").alias("standard_code_share"),
        (F.sum("asks") / F.nullif(F.sum("answers"), F.lit(0))).alias("request_response_ratio"),
        F.avg("n").alias("packets_per_flow"),
        F.avg(seconds(F.col("first_ts"), F.col("last_ts"))).alias("flow_duration_seconds"),
        F.avg(F.col("asks") / F.nullif("answers", F.lit(0))).alias("flow_symmetry"),
        (seconds(F.min("first_ts"), F.max("last_ts")) / 3600).alias("collection_hours"),
        F.sum("n").cast("double").alias("collection_packets"),
    )


def half_metrics(features: DataFrame, port: int) -> DataFrame:
    """Per capture: is the second half of its time like the first?

    ``mapping_stability`` is the share of the second half's packets whose pair of server address and unit was seen in
    the first half, ``length_drift_sigma`` the distance of the halves' mean lengths in deviations of all lengths.
    Packets are counted per pair first, so a capture is merged from one row per pair. NULL without a second half.
    """
    us, length = F.unix_micros("ts"), F.col("packet_length").cast("long")
    ends = features.groupBy("capture_id").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    rows = modbus_messages(features, port).select("capture_id", "server_ip", "unit_id", us.alias("us"), length.alias("x"))
    late = F.col("us") * 2 > F.col("first_us") + F.col("last_us")
    halves = join_null_safe(rows, ends, ["capture_id"], "inner").withColumn("late", late)
    pairs = halves.groupBy("capture_id", "server_ip", "unit_id").agg(
        F.count_if(~F.col("late")).alias("n1"),
        F.count_if(F.col("late")).alias("n2"),
        F.sum(F.when(~F.col("late"), F.col("x"))).alias("x1"),
        F.sum(F.when(F.col("late"), F.col("x"))).alias("x2"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
    )
    n, x = F.sum("n1") + F.sum("n2"), F.coalesce(F.sum("x1"), F.lit(0)) + F.coalesce(F.sum("x2"), F.lit(0))
    known = F.sum(F.when(F.col("n1") > 0, F.col("n2")).otherwise(0))
    # Whole sums in decimals: squares of a large capture's lengths cancel almost entirely.
    whole = lambda c: c.cast("decimal(38,0)")
    spread = F.sqrt((whole(n) * whole(F.sum("xx")) - whole(x) * whole(x)).cast("double") / n / F.nullif(n - 1, F.lit(0)))
    means = [F.sum(a) / F.nullif(F.sum(b), F.lit(0)) for a, b in (("x1", "n1"), ("x2", "n2"))]
    return pairs.groupBy("capture_id").agg(
        (known / F.nullif(F.sum("n2"), F.lit(0))).alias("mapping_stability"),
        (F.abs(means[1] - means[0]) / F.nullif(spread, F.lit(0.0))).alias("length_drift_sigma"),
    )


def conversation_metrics(
    features: DataFrame,
    port: int,
    keys: Sequence[str] = MESSAGE_KEYS,
    timeout_seconds: float = 10.0,
    cell_seconds: float = 60.0,
    lag: int = 1,
) -> DataFrame:
    """One row per capture with the observed value of every criterion on conversations and on the collection's halves.

    ``keys`` say which messages belong together, ``lag`` how many packets a polling round has. An orphan is a request
    without a response in time or a response that no request found. ``coverage_share`` counts packets of units with a
    baseline of their own.
    """
    key = ["capture_id"]
    # Read by pairing, steps, intervals, halves and coverage.
    features = settle(
        features.select(*key, "packet_number", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "unit_id", "transaction_id", "packet_length")
    )
    messages = modbus_messages(features, port)
    pairs = settle(pair_requests(messages, keys=keys, timeout_seconds=timeout_seconds, cell_seconds=cell_seconds))
    answered = pairs.where("response_number IS NOT NULL")
    delays = answered.groupBy(*key).agg(F.count(F.lit(1)).alias("matched"), F.avg("response_delay_ms").alias("response_delay_mean_ms"))
    taken = answered.select(*key, "response_number").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("taken"))
    p95 = quantile_table(pairs, {"response_delay_p95_ms": ("response_delay_ms", 0.95)}, key, stored=True)
    out = features.groupBy(*key).agg(F.count(F.lit(1)).alias("packets"))
    conversation = [k for k in keys if k not in ("unit_id", "transaction_id")]
    steps = transaction_steps(messages, conversation).groupBy(*key).agg(F.avg(F.col("regular").cast("int")).alias("regular_id_share"))
    periodic = iat_autocorrelation(features, lag, key).select(*key, "autocorrelation")
    baseline = build_baseline(features, ["packet_length"])
    inside = F.col("packet_length").between(F.col("packet_length_low"), F.col("packet_length_high"))
    covered = features.join(baseline.drop("packets"), "unit_id").groupBy(*key).agg(F.avg(inside.cast("int")).alias("coverage_share"))
    for part in (delays, taken, p95, steps, periodic, half_metrics(features, port), covered):
        out = join_null_safe(out, part, key)
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumn("orphan_packet_share", (F.col("packets") - none("matched") - none("taken")) / F.col("packets")).drop("packets", "matched", "taken")


def conversation_compliance(features: DataFrame, port: int, **pairing: object) -> DataFrame:
    """As ``compliance``, for conversations and the two halves of the collection; ``pairing`` goes to the metrics."""
    return _checked(conversation_metrics(features, port, **pairing), C.CONVERSATION_CRITERIA)


def message_compliance(features: DataFrame, port: int) -> DataFrame:
    """As ``compliance``, for messages, flows and the collection."""
    return _checked(message_metrics(features, port), C.MESSAGE_CRITERIA)


def compliance(features: DataFrame) -> DataFrame:
    """Each criterion per capture: observed value, expected range and whether it holds (NULL when unknown)."""
    return _checked(observed_metrics(features), C.BASELINE_CRITERIA)


def _checked(observed: DataFrame, criteria: list[tuple[str, float | None, float | None]]) -> DataFrame:
    def bound(x: float | None):
        return F.lit(x).cast("double")

    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("criterion"),
                F.col(name).cast("double").alias("observed"),
                bound(low).alias("low"),
                bound(high).alias("high"),
            )
            for name, low, high in criteria
        ]
    )
    out = observed.select("capture_id", F.inline(rows))
    above = F.coalesce(F.col("observed") >= F.col("low"), F.lit(True))
    below = F.coalesce(F.col("observed") <= F.col("high"), F.lit(True))
    return out.withColumn("passed", F.when(F.col("observed").isNotNull(), above & below))
