"""Rule-based detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain.operators import rules as R
from wiregrain.operators.baseline import (
    baseline_coverage,
    build_baseline,
    compliance,
    usual_codes,
)
from wiregrain.operators.decode import MODBUS
from wiregrain.operators.features import entropy_features, operation_flags, validation_flags
from wiregrain.operators.windows import rolling_features
from wiregrain.plans.queries.packets import modbus, narrow
from wiregrain.plans.queries.registry import ENTROPY, PACKETS, ROLLING, query, tidy
from wiregrain.session import settle


def ruled_features(spark, folder):
    """What the rules read, without the flow counts."""
    rows = (
        modbus(spark, folder)
        .transform(operation_flags, MODBUS)
        .transform(validation_flags, MODBUS)
        .transform(entropy_features, MODBUS)
    )
    return rolling_features(settle(rows.drop("payload", "data")), ["timing", "function_code"])


_FLAGS = (
    PACKETS
    + ENTROPY
    + ROLLING
    + """,
b AS (SELECT capture_id, avg(packet_length) AS lm, stddev_samp(packet_length) AS ls, avg(time_delta_ms) AS im, stddev_samp(time_delta_ms) AS isd,
        count(DISTINCT function_code) AS fcs FROM roll GROUP BY capture_id),
f AS (SELECT roll.*, fcs,
  coalesce(packet_length > lm + 2 * ls, false) OR coalesce(packet_length < lm - 2 * ls, false) OR coalesce(time_delta_ms > im + 2 * isd, false)
    OR coalesce(time_delta_ms < greatest(0, im - 2 * isd), false) OR payload_entropy < 2.0 OR payload_entropy > 7.0 AS statistical_anomaly,
  protocol_id_valid = 0 OR unit_id_valid = 0 OR length_consistent = 0
    OR (is_read_operation = 0 AND is_write_operation = 0 AND is_error_response = 0 AND function_code BETWEEN 7 AND 127) AS protocol_violation,
  burst_streak >= 10 OR function_code_stability_10 < 0.5 OR fcs > 10 AS pattern_anomaly
  FROM roll JOIN b USING (capture_id))"""
)


@query(
    "rule_flags",
    f"WITH {_FLAGS} SELECT capture_id, packet_number, statistical_anomaly, protocol_violation, pattern_anomaly, statistical_anomaly OR protocol_violation OR pattern_anomaly AS is_anomaly FROM f",
)
def rule_flags(spark, folder):
    return R.flag_anomalies(settle(ruled_features(spark, folder))).select(
        "capture_id",
        "packet_number",
        "statistical_anomaly",
        "protocol_violation",
        "pattern_anomaly",
        "is_anomaly",
    )


@query(
    "anomaly_report",
    f"""WITH {_FLAGS}
SELECT capture_id, packet_number, us AS ts, src_ip, dst_ip, function_code, function_name, packet_length, round(time_delta_ms, 4) AS time_delta_ms,
  round(payload_entropy, 4) AS payload_entropy,
  concat_ws('; ', CASE WHEN pattern_anomaly AND burst_streak >= 10 AND time_delta_ms < 1 THEN 'Pattern Anomaly: Burst Traffic (IAT < 1ms)' END,
    CASE WHEN fcs > 10 THEN 'Pattern Anomaly: Function Code Scanning Detected in Flow' END,
    CASE WHEN function_code_stability_10 < 0.5 THEN 'Pattern Anomaly: Rapid Function Code Change' END,
    CASE WHEN protocol_violation THEN 'Protocol Violation (Invalid Protocol ID, Unit ID, Length Mismatch, or Reserved FC)' END,
    CASE WHEN statistical_anomaly THEN 'Statistical Outlier (Packet Size, IAT, or Entropy)' END) AS anomaly_reasons
FROM f WHERE statistical_anomaly OR protocol_violation OR pattern_anomaly""",
)
def anomaly_report(spark, folder):
    report = R.detect_anomalies(settle(ruled_features(spark, folder)))
    return tidy(report.withColumn("anomaly_reasons", F.array_join("anomaly_reasons", "; ")), 4)


@query(
    "packet_indicators",
    f"""WITH {PACKETS}{ENTROPY}
SELECT capture_id, count(*) AS packets, u.indicator, CASE u.indicator
  WHEN 'structured_entropy' THEN count(*) FILTER (payload_entropy < 3.5) WHEN 'suspicious_entropy' THEN count(*) FILTER (payload_entropy > 6.5)
  WHEN 'reserved_function_code' THEN count(*) FILTER (function_code BETWEEN 7 AND 14 OR function_code BETWEEN 17 AND 19 OR function_code BETWEEN 24 AND 127)
  WHEN 'invalid_protocol_id' THEN count(*) FILTER (protocol_id <> 0) WHEN 'invalid_unit_id' THEN count(*) FILTER (NOT unit_id BETWEEN 1 AND 247)
  WHEN 'length_mismatch' THEN count(*) FILTER (length_consistent = 0) ELSE count(*) FILTER (function_code IS NULL) END AS hits
FROM pe, (SELECT unnest(['structured_entropy', 'suspicious_entropy', 'reserved_function_code', 'invalid_protocol_id', 'invalid_unit_id', 'length_mismatch', 'malformed']) AS indicator) u
GROUP BY capture_id, u.indicator""",
)
def packet_indicators(spark, folder):
    return R.packet_indicators(ruled_features(spark, folder))


@query(
    "capture_indicators",
    f"""WITH {PACKETS},
g AS (SELECT *, (us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_number)) / 1e6 AS d FROM pk)
SELECT capture_id, round(stddev_samp(d) / avg(d), 6) AS iat_cv, count(DISTINCT function_code) AS function_codes,
  stddev_samp(d) / avg(d) > 0.7 AS irregular_timing, count(DISTINCT function_code) > 10 AS code_scanning FROM g GROUP BY capture_id""",
)
def capture_indicators(spark, folder):
    rows = rolling_features(narrow(spark, folder, "ts", "function_code"), ["timing"])
    return tidy(R.capture_indicators(rows))


@query(
    "baseline_builder",
    f"""WITH {PACKETS}{ENTROPY}{ROLLING}
SELECT unit_id % 8 AS unit_id, count(*) AS packets,
  round(avg(packet_length) - 2 * stddev_samp(packet_length), 4) AS packet_length_low, round(avg(packet_length) + 2 * stddev_samp(packet_length), 4) AS packet_length_high,
  round(avg(payload_entropy) - 2 * stddev_samp(payload_entropy), 4) AS payload_entropy_low, round(avg(payload_entropy) + 2 * stddev_samp(payload_entropy), 4) AS payload_entropy_high,
  round(avg(time_delta_ms) - 2 * stddev_samp(time_delta_ms), 4) AS time_delta_ms_low, round(avg(time_delta_ms) + 2 * stddev_samp(time_delta_ms), 4) AS time_delta_ms_high
FROM roll GROUP BY unit_id % 8 HAVING count(*) >= 100""",
)
def baseline_builder(spark, folder):
    """Units folded to eight, so that they reach the minimum packet count."""
    rows = ruled_features(spark, folder).withColumn("unit_id", F.col("unit_id") % 8)
    return tidy(build_baseline(rows), 4)


@query(
    "baseline_coverage",
    f"""WITH {PACKETS}, p AS (SELECT unit_id % 8 AS unit_id, packet_length FROM pk),
b AS (SELECT unit_id, avg(packet_length) - 2 * stddev_samp(packet_length) AS lo, avg(packet_length) + 2 * stddev_samp(packet_length) AS hi FROM p GROUP BY unit_id HAVING count(*) >= 100)
SELECT unit_id, count(*) AS packets, round(avg(CAST(packet_length BETWEEN lo AND hi AS INTEGER)), 6) AS coverage FROM p JOIN b USING (unit_id) GROUP BY unit_id""",
)
def coverage(spark, folder):
    rows = narrow(spark, folder, "unit_id", "packet_length").withColumn("unit_id", F.col("unit_id") % 8)
    return tidy(baseline_coverage(rows, build_baseline(rows, ["packet_length"])))


@query(
    "usual_codes",
    f"WITH {PACKETS} SELECT unit_id, function_code, count(*) AS n FROM pk GROUP BY ALL HAVING count(*) >= 10",
)
def codes_in_use(spark, folder):
    return usual_codes(modbus(spark, folder))


@query(
    "baseline_compliance",
    f"""WITH {PACKETS}{ENTROPY}{ROLLING},
o AS (SELECT capture_id, avg(time_delta) * 1000 AS iat_mean_ms, stddev_samp(time_delta) * 1000 AS iat_std_ms, stddev_samp(time_delta) / avg(time_delta) AS iat_cv,
    max(time_delta) / avg(time_delta) AS iat_max_over_mean, stddev_pop(time_delta) / avg(time_delta) AS iat_jitter,
    avg(header_entropy) AS header_entropy_mean, avg(full_packet_entropy) AS full_packet_entropy_mean, avg(function_code_stability_10) AS fc_stability,
    count(*) FILTER (function_code = 3) / count(*) AS fc_3_share, count(*) FILTER (function_code = 16) / count(*) AS fc_16_share, avg(packet_length) AS length_mean, stddev_samp(packet_length) AS length_std,
    min(packet_length) AS length_min, max(packet_length) AS length_max, stddev_samp(packet_length) / avg(packet_length) AS length_cv,
    avg(payload_entropy) AS payload_entropy_mean, count(DISTINCT function_code) AS function_codes, avg(function_code_changes) AS fc_change_share,
    avg(is_error_response) AS error_share, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT unit_id) AS unique_unit_ids
  FROM roll GROUP BY capture_id),
c AS (SELECT * FROM (VALUES ('iat_mean_ms', 10.0, 1000.0), ('iat_std_ms', 5.0, 500.0), ('iat_cv', NULL, 0.5), ('iat_max_over_mean', NULL, 5.0), ('iat_jitter', NULL, 0.3), ('header_entropy_mean', 2.0, 4.0), ('full_packet_entropy_mean', 3.0, 6.0), ('fc_stability', 0.5, NULL), ('fc_3_share', 0.4, 0.7), ('fc_16_share', 0.1, 0.3), ('length_mean', 60.0, 300.0),
  ('length_std', 10.0, 50.0), ('length_min', 12.0, NULL), ('length_max', NULL, 260.0), ('length_cv', 0.1, 0.5), ('payload_entropy_mean', 3.5, 6.5), ('function_codes', 2.0, 8.0),
  ('fc_change_share', NULL, 0.3), ('error_share', NULL, 0.02), ('unique_src_ips', 1.0, 5.0), ('unique_dst_ips', 1.0, 50.0), ('unique_unit_ids', 1.0, 50.0)) t(criterion, low, high)),
v AS (SELECT capture_id, criterion, CASE criterion WHEN 'iat_mean_ms' THEN iat_mean_ms WHEN 'iat_std_ms' THEN iat_std_ms WHEN 'iat_cv' THEN iat_cv WHEN 'iat_max_over_mean' THEN iat_max_over_mean WHEN 'iat_jitter' THEN iat_jitter WHEN 'header_entropy_mean' THEN header_entropy_mean
  WHEN 'full_packet_entropy_mean' THEN full_packet_entropy_mean WHEN 'fc_stability' THEN fc_stability WHEN 'fc_3_share' THEN fc_3_share WHEN 'fc_16_share' THEN fc_16_share
  WHEN 'length_mean' THEN length_mean WHEN 'length_std' THEN length_std WHEN 'length_min' THEN length_min WHEN 'length_max' THEN length_max WHEN 'length_cv' THEN length_cv
  WHEN 'payload_entropy_mean' THEN payload_entropy_mean WHEN 'function_codes' THEN function_codes WHEN 'fc_change_share' THEN fc_change_share WHEN 'error_share' THEN error_share
  WHEN 'unique_src_ips' THEN unique_src_ips WHEN 'unique_dst_ips' THEN unique_dst_ips ELSE unique_unit_ids END AS observed, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM o, c)
SELECT capture_id, criterion, round(observed, 4) AS observed, low, high, coalesce(observed >= low, true) AND coalesce(observed <= high, true) AS passed FROM v""",
)
def baseline_compliance(spark, folder):
    """Skewness and the dominant code are compared by `iat_shape` and `traffic_stats`."""
    rows = compliance(ruled_features(spark, folder))
    return tidy(rows.where(~F.col("criterion").isin("iat_skewness", "dominant_fc_share")), 4)
