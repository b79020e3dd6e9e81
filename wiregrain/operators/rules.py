"""Rule-based anomaly detection, per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrain import constants as C
from wiregrain.session import settle


def _false(condition: Column) -> Column:
    """A comparison with a missing value is not an anomaly."""
    return F.coalesce(condition, F.lit(False))


def capture_baseline(features: DataFrame) -> DataFrame:
    """Mean and sample deviation of size, inter-arrival time and entropy, and distinct codes, per capture."""
    return features.groupBy("capture_id").agg(
        F.avg("packet_length").alias("base_length_mean"),
        F.stddev_samp("packet_length").alias("base_length_std"),
        F.avg("time_delta_ms").alias("base_iat_mean"),
        F.stddev_samp("time_delta_ms").alias("base_iat_std"),
        F.avg("payload_entropy").alias("base_entropy_mean"),
        F.stddev_samp("payload_entropy").alias("base_entropy_std"),
        F.countDistinct("function_code").alias("base_function_codes"),
    )


def statistical_rule() -> Column:
    """Size or inter-arrival time outside two deviations, or entropy outside its hard bounds."""
    size, iat, entropy = F.col("packet_length"), F.col("time_delta_ms"), F.col("payload_entropy")
    size_margin = F.lit(C.SIGMA) * F.col("base_length_std")
    iat_margin = F.lit(C.SIGMA) * F.col("base_iat_std")
    iat_floor = F.when(
        F.col("base_iat_mean").isNotNull() & iat_margin.isNotNull(),
        F.greatest(F.lit(0.0), F.col("base_iat_mean") - iat_margin),
    )
    return (
        _false(F.abs(size - F.col("base_length_mean")) > size_margin)
        | _false(iat > F.col("base_iat_mean") + iat_margin)
        | _false(iat < iat_floor)
        | _false(entropy < C.ENTROPY_LOW)
        | _false(entropy > C.ENTROPY_HIGH)
    )


def protocol_rule() -> Column:
    """A failed header check, or a code of 7..127 that is neither a read, a write nor an error."""
    failed = [F.col(c) == 0 for c in ("protocol_id_valid", "unit_id_valid", "length_consistent")]
    idle = (
        (F.col("is_read_operation") == 0)
        & (F.col("is_write_operation") == 0)
        & (F.col("is_error_response") == 0)
    )
    out = _false(idle & F.col("function_code").between(7, 127))
    for f in failed:
        out = out | _false(f)
    return out


def scan_rule() -> Column:
    return _false(F.col("base_function_codes") > C.MAX_FUNCTION_CODES)


def rapid_change_rule() -> Column:
    return _false(F.col("function_code_stability_10") < C.STABILITY_MIN)


def burst_rule() -> Column:
    return _false(F.col("is_burst"))


def flag_anomalies(features: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Rule columns, ``is_anomaly`` and the sorted reasons on every packet.

    The baseline is that of the packets themselves unless a stored one is given; then
    ``features`` is read twice, so settle it first.
    It is settled, so its join is a broadcast whenever Spark sees that it is small.
    """
    baseline = settle(capture_baseline(features)) if baseline is None else baseline
    pattern = scan_rule() | rapid_change_rule() | burst_rule()
    rows = features.join(baseline, "capture_id", "left").withColumns(
        {
            "statistical_anomaly": statistical_rule(),
            "protocol_violation": protocol_rule(),
            "pattern_anomaly": pattern,
        }
    )
    # A short gap alone is no burst: the run of short gaps must be there too.
    in_burst = burst_rule() & _false(F.col("time_delta_ms") < C.BURST_MS)
    reasons = F.array(
        F.when(F.col("statistical_anomaly"), C.REASON_STATISTICAL),
        F.when(F.col("protocol_violation"), C.REASON_PROTOCOL),
        F.when(F.col("pattern_anomaly") & scan_rule(), C.REASON_SCAN),
        F.when(F.col("pattern_anomaly") & rapid_change_rule(), C.REASON_RAPID),
        F.when(in_burst, C.REASON_BURST),
    )
    return rows.withColumns(
        {
            "is_anomaly": F.col("statistical_anomaly")
            | F.col("protocol_violation")
            | F.col("pattern_anomaly"),
            "anomaly_reasons": F.array_sort(F.array_distinct(F.array_compact(reasons))),
        }
    ).drop(*[c for c in baseline.columns if c.startswith("base_")])


def anomaly_report(flagged: DataFrame) -> DataFrame:
    """Only the anomalous packets, with what a reader needs to see why."""
    return flagged.where("is_anomaly").select(
        "capture_id",
        "packet_number",
        "ts",
        "src_ip",
        "dst_ip",
        "function_code",
        "function_name",
        "packet_length",
        "time_delta_ms",
        "payload_entropy",
        "anomaly_reasons",
    )


def detect_anomalies(features: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    return anomaly_report(flag_anomalies(features, baseline))


# --- further indicators --------------------------------------------------------


def reserved_code() -> Column:
    code = F.col("function_code")
    out = F.lit(False)
    for low, high in C.RESERVED_CODES:
        out = out | code.between(low, high)
    return _false(out)


PACKET_INDICATORS = {
    "structured_entropy": lambda: _false(F.col("payload_entropy") < C.ENTROPY_NORMAL[0]),
    "suspicious_entropy": lambda: _false(F.col("payload_entropy") > C.ENTROPY_NORMAL[1]),
    "reserved_function_code": reserved_code,
    "invalid_protocol_id": lambda: _false(F.col("protocol_id") != 0),
    "invalid_unit_id": lambda: _false(~F.col("unit_id").between(*C.MODBUS_UNIT_RANGE)),
    "length_mismatch": lambda: _false(F.col("length_consistent") == 0),
    "malformed": lambda: F.col("function_code").isNull(),
}


def packet_indicators(features: DataFrame) -> DataFrame:
    """Hits per capture and packet-level indicator, as rows ``(capture_id, indicator, hits, packets)``."""
    hits = features.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"),
        *[F.count_if(rule()).alias(name) for name, rule in PACKET_INDICATORS.items()],
    )
    pairs = ", ".join(f"'{n}', `{n}`" for n in PACKET_INDICATORS)
    return hits.select(
        "capture_id", "packets", F.expr(f"stack({len(PACKET_INDICATORS)}, {pairs}) as (indicator, hits)")
    )


def capture_indicators(features: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Capture-level indicators: irregular timing, code scanning and, given request pairs, orphaned requests."""
    iat = F.col("time_delta")
    out = features.groupBy("capture_id").agg(
        (F.stddev_samp(iat) / F.nullif(F.avg(iat), F.lit(0.0))).alias("iat_cv"),
        F.countDistinct("function_code").alias("function_codes"),
    )
    out = out.withColumns(
        {
            "irregular_timing": _false(F.col("iat_cv") > 0.7),
            "code_scanning": F.col("function_codes") > C.MAX_FUNCTION_CODES,
        }
    )
    if pairs is not None:
        orphans = pairs.groupBy("capture_id").agg(
            F.avg(F.col("response_delay_ms").isNull().cast("int")).alias("orphan_share")
        )
        out = out.join(orphans, "capture_id", "left").withColumn(
            "orphaned_requests", _false(F.col("orphan_share") > 0.05)
        )
    return out


def malformed_connections(weird: DataFrame, conn: DataFrame) -> DataFrame:
    """Malformed-traffic names with hits and the connections they came from, from Zeek logs."""
    per_conn = weird.groupBy("uid", "name").agg(F.count(F.lit(1)).alias("hits"))
    ends = conn.select("uid", F.col("id_orig_h").alias("src_ip"), F.col("id_resp_h").alias("dst_ip"))
    return (
        per_conn.join(ends, "uid", "left")
        .groupBy("name", "src_ip", "dst_ip")
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("connections"))
    )
