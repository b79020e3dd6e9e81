"""Summaries, fingerprints, distributions and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain.operators import distributions as G
from wiregrain.operators import fingerprint as P
from wiregrain.operators import outliers as O
from wiregrain.operators import stats as S
from wiregrain.operators.decode import MODBUS
from wiregrain.operators.features import entropy_features, operation_flags
from wiregrain.operators.windows import rolling_features
from wiregrain.plans.queries.packets import modbus, narrow
from wiregrain.plans.queries.registry import ENTROPY, PACKETS, ROLLING, query, tidy
from wiregrain.plans.tables import labelled_documents, table
from wiregrain.session import settle


def _timed(spark, folder):
    rows = operation_flags(modbus(spark, folder), MODBUS)
    rows = entropy_features(rows, MODBUS)
    return rolling_features(settle(rows.drop("payload", "data")), ["timing"])


@query(
    "summary_stats",
    f"""WITH {PACKETS}{ENTROPY}{ROLLING}
SELECT capture_id, count(*) AS total_packets, count(DISTINCT function_code) AS unique_function_codes,
  round(avg(packet_length), 4) AS length_mean, round(stddev_samp(packet_length), 4) AS length_std,
  min(packet_length) AS length_min, max(packet_length) AS length_max,
  round(stddev_samp(packet_length) / avg(packet_length), 4) AS length_cv,
  round(avg(time_delta_ms), 4) AS iat_mean_ms, round(stddev_samp(time_delta_ms), 4) AS iat_std_ms,
  round(min(time_delta_ms), 4) AS iat_min_ms, round(max(time_delta_ms), 4) AS iat_max_ms,
  round(stddev_samp(time_delta_ms) / avg(time_delta_ms), 4) AS iat_cv,
  count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT unit_id) AS unique_unit_ids,
  round(avg(payload_entropy), 4) AS payload_entropy_mean, round(stddev_pop(payload_entropy), 4) AS payload_entropy_std,
  round(avg(header_entropy), 4) AS header_entropy_mean, round(stddev_pop(header_entropy), 4) AS header_entropy_std,
  round(avg(CAST(payload_entropy BETWEEN 3.5 AND 6.5 AS INTEGER)) * 100, 4) AS normal_entropy_pct,
  CAST(sum(is_read_operation) AS BIGINT) AS read_count, CAST(sum(is_write_operation) AS BIGINT) AS write_count,
  CAST(sum(is_error_response) AS BIGINT) AS error_count,
  round(avg(is_read_operation) * 100, 4) AS read_pct,
  count(*) FILTER (is_valid) AS valid_packets, count(*) FILTER (NOT is_valid) AS invalid_packets,
  round(avg(CAST(is_valid AS INTEGER)) * 100, 4) AS validity_rate,
  round(quantile_cont(packet_length, 0.5), 4) AS length_median, round(quantile_cont(time_delta_ms, 0.5), 4) AS iat_median_ms,
  round(quantile_cont(payload_entropy, 0.25), 4) AS payload_entropy_q25, round(quantile_cont(header_entropy, 0.75), 4) AS header_entropy_q75
FROM roll GROUP BY capture_id""",
)
def summary_stats(spark, folder):
    out = S.summary_statistics(_timed(spark, folder))
    left_out = [
        "payload_entropy_min",
        "payload_entropy_max",
        "header_entropy_min",
        "header_entropy_max",
        "write_pct",
        "error_pct",
        "payload_entropy_median",
        "payload_entropy_q75",
        "header_entropy_median",
        "header_entropy_q25",
    ]
    return tidy(out.drop(*left_out), 4)


@query(
    "distribution_maps",
    f"""WITH {PACKETS}, c AS (SELECT capture_id, function_code, count(*) AS n FROM pk GROUP BY ALL)
SELECT capture_id, string_agg(function_code || ':' || n, ',' ORDER BY function_code) AS codes FROM c GROUP BY capture_id""",
)
def distribution_maps(spark, folder):
    maps = S.distribution_map(modbus(spark, folder), "function_code")
    entries = F.array_sort(F.map_entries("function_code_distribution"))
    text = F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return maps.select("capture_id", F.array_join(text, ",").alias("codes"))


@query(
    "traffic_stats",
    f"""WITH {PACKETS},
g AS (SELECT *, (us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_number)) / 1e6 AS d FROM pk),
c AS (SELECT capture_id, function_code, count(*) AS n FROM pk GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, function_code) AS r,
        count(*) OVER (PARTITION BY capture_id) AS div FROM c)
SELECT g.capture_id, round((max(us) - min(us)) / 1e6, 4) AS total_duration_seconds,
  round(count(*) / greatest((max(us) - min(us)) / 1e6, 1), 4) AS packet_per_second, round(avg(d) * 1000, 4) AS avg_inter_arrival_ms,
  round(avg(packet_length), 4) AS avg_packet_size, round(stddev_samp(packet_length), 4) AS size_variability,
  CASE WHEN stddev_samp(packet_length) < 50 THEN 'consistent' ELSE 'variable' END AS size_consistency,
  round(sum(is_read_operation) / greatest(sum(is_write_operation), 1), 4) AS read_write_ratio,
  any_value(t.function_code) AS top_code, any_value(t.n) AS top_count, round(any_value(t.n) / count(*) * 100, 4) AS top_percentage,
  any_value(t.div) AS function_diversity
FROM g JOIN t ON g.capture_id = t.capture_id AND t.r = 1 GROUP BY g.capture_id""",
)
def traffic_stats(spark, folder):
    rows = operation_flags(narrow(spark, folder, "ts", "packet_length", "function_code"), MODBUS)
    return tidy(S.traffic_statistics(rolling_features(rows, ["timing"])), 4)


@query(
    "analysis_report",
    f"""WITH {PACKETS},
c AS (SELECT function_code, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS p FROM pk GROUP BY function_code),
w AS (SELECT count(*) AS total, count(DISTINCT src_ip) AS s, count(DISTINCT dst_ip) AS d, count(DISTINCT unit_id) AS u FROM pk)
SELECT 'Executive Summary' AS section, 0 AS position, 'total_packets' AS metric, CAST(total AS VARCHAR) AS value FROM w
UNION ALL SELECT 'Network Topology', 8, 'unique_sources', CAST(s AS VARCHAR) FROM w
UNION ALL SELECT 'Network Topology', 9, 'unique_destinations', CAST(d AS VARCHAR) FROM w
UNION ALL SELECT 'Network Topology', 10, 'unique_unit_ids', CAST(u AS VARCHAR) FROM w
UNION ALL SELECT 'Protocol Usage', 5, 'function_diversity', CAST(count(*) AS VARCHAR) FROM c
UNION ALL SELECT 'Protocol Usage', 6, 'top_code', CAST((SELECT function_code FROM c ORDER BY n DESC, function_code LIMIT 1) AS VARCHAR)
UNION ALL SELECT 'Detailed Function Code Distribution', 1000 + function_code, 'code_' || function_code, printf('%d packets (%.1f%%)', n, p) FROM c""",
)
def analysis_report(spark, folder):
    columns = ["ts", "packet_length", "function_code", "src_ip", "dst_ip", "unit_id"]
    rows = operation_flags(narrow(spark, folder, *columns), MODBUS)
    report = S.analysis_report(rolling_features(rows, ["timing"]))
    # The remaining lines hold formatted averages, which `traffic_stats` compares as numbers.
    averages = ["packet_per_second", "avg_packet_size", "size_consistency", "read_write_ratio", "top_percentage"]
    return report.where(~F.col("metric").isin(averages))


@query(
    "fc_distribution",
    f"""WITH {PACKETS}
SELECT capture_id, function_code, function_name, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY capture_id) * 100, 6) AS percentage
FROM pk GROUP BY capture_id, function_code, function_name""",
)
def fc_distribution(spark, folder):
    return tidy(S.function_code_distribution(modbus(spark, folder)))


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "group_fingerprint",
    """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS e,
    quantile_cont(l_discount, 0.5) AS d, quantile_cont(l_tax, 0.5) AS t FROM lineitem)
SELECT l_returnflag, l_linestatus, """
    + ", ".join(
        f"round(avg({f}), 4) AS {f}_mean, round(stddev_samp({f}), 4) AS {f}_std, count({f}) AS {f}_count, "
        f"count(*) FILTER ({f} < {m}) AS {f}_count_below_threshold, count(*) FILTER ({f} > {m}) AS {f}_count_above_threshold"
        for f, m in zip(_LINE_FEATURES, "qedt")
    )
    + " FROM lineitem, m GROUP BY l_returnflag, l_linestatus",
)
def group_fingerprint(spark, folder):
    rows = table(spark, folder, "lineitem")
    return tidy(P.group_stats(rows, ["l_returnflag", "l_linestatus"], _LINE_FEATURES, stored=True), 4)


@query(
    "group_fingerprint_thresholds",
    """SELECT user_id, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std, count(value) AS value_count,
  count(*) FILTER (value < 50) AS value_count_below_threshold, count(*) FILTER (value > 50) AS value_count_above_threshold
FROM events GROUP BY user_id""",
)
def group_fingerprint_thresholds(spark, folder):
    events = table(spark, folder, "events")
    return tidy(P.group_stats(events, ["user_id"], ["value"], {"value": 50.0}))


_MIXED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "frequency_distributions",
    """WITH long AS (
  SELECT l_returnflag, l_linestatus, 'l_quantity' AS feature, l_quantity AS x FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'l_tax', l_tax FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'l_linenumber', CAST(l_linenumber AS DOUBLE) FROM lineitem),
s AS (SELECT l_returnflag, l_linestatus, feature, min(x) AS lo, max(x) AS hi, count(*) AS total, count(DISTINCT x) AS d FROM long GROUP BY ALL),
j AS (SELECT long.*, lo, hi, total, d, (hi - lo) / 10 AS step FROM long JOIN s USING (l_returnflag, l_linestatus, feature)),
g AS (SELECT *, least(CAST(floor((x - lo) * (10 / (hi - lo))) AS INTEGER), 9) AS g FROM j WHERE d > 10),
h AS (SELECT l_returnflag, l_linestatus, feature, g - CAST(x < lo + g * step AS INTEGER) + CAST(x >= lo + (g + 1) * step AND g < 9 AS INTEGER) AS bin, count(*) AS n FROM g GROUP BY ALL),
hist AS (SELECT s.l_returnflag, s.l_linestatus, s.feature, 'hist' AS kind, b.bin + 1 AS position, lo + b.bin * (hi - lo) / 10 AS bin_lo,
    CASE WHEN b.bin = 9 THEN hi ELSE lo + (b.bin + 1) * (hi - lo) / 10 END AS bin_hi, NULL AS value, coalesce(n, 0) AS n, coalesce(n, 0) / total AS share, total
  FROM s CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN h ON h.l_returnflag = s.l_returnflag AND h.l_linestatus = s.l_linestatus AND h.feature = s.feature AND h.bin = b.bin
  WHERE d > 10),
vc AS (SELECT l_returnflag, l_linestatus, feature, x AS value, count(*) AS n, any_value(total) AS total FROM j WHERE d <= 10 GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, feature ORDER BY n DESC, value) AS position FROM vc)
SELECT l_returnflag, l_linestatus, feature, kind, CAST(position AS INTEGER) AS position, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi,
  CAST(value AS DOUBLE) AS value, n, round(share, 6) AS share, total FROM hist
UNION ALL
SELECT l_returnflag, l_linestatus, feature, 'value_counts', CAST(position AS INTEGER), NULL, NULL, round(value, 6), n, round(n / total, 6), total FROM top WHERE position <= 10""",
)
def frequency_distributions(spark, folder):
    rows = table(spark, folder, "lineitem")
    return tidy(P.frequency_distributions(rows, ["l_returnflag", "l_linestatus"], _MIXED))


@query(
    "histogram_20",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
g AS (SELECT o_totalprice AS x, lo, hi, (hi - lo) / 20 AS step, least(CAST(floor((o_totalprice - lo) * (20 / (hi - lo))) AS INTEGER), 19) AS g FROM orders, s),
h AS (SELECT g - CAST(x < lo + g * step AS INTEGER) + CAST(x >= lo + (g + 1) * step AND g < 19 AS INTEGER) AS bin, count(*) AS n FROM g GROUP BY ALL)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * (hi - lo) / 20, 4) AS bin_lo, round(lo + (b.bin + 1) * (hi - lo) / 20, 4) AS bin_hi, coalesce(n, 0) AS n
FROM s CROSS JOIN (SELECT unnest(range(20)) AS bin) b LEFT JOIN h ON h.bin = b.bin""",
)
def histogram_20(spark, folder):
    return tidy(G.histogram(table(spark, folder, "orders"), "o_totalprice", 20), 4)


@query(
    "fingerprint_compare",
    """WITH a AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events WHERE value < 30 GROUP BY event_type),
b AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events WHERE value >= 30 AND event_type <> 'error' GROUP BY event_type)
SELECT coalesce(a.event_type, b.event_type) AS event_type, 'value' AS feature, round(a.m, 6) AS mean_left, round(b.m, 6) AS mean_right,
  a.n AS n_left, b.n AS n_right, round(b.m - a.m, 6) AS mean_delta, round(b.s - a.s, 6) AS std_delta,
  CASE WHEN a.n IS NULL THEN 'only_right' WHEN b.n IS NULL THEN 'only_left' ELSE 'both' END AS presence
FROM a FULL JOIN b ON a.event_type = b.event_type""",
)
def fingerprint_compare(spark, folder):
    events = table(spark, folder, "events")
    low, high = F.col("value") < 30, (F.col("value") >= 30) & (F.col("event_type") != "error")
    sides = [
        P.stats_long(P.group_stats(events.where(part), ["event_type"], ["value"], 50.0), ["event_type"])
        for part in (low, high)
    ]
    return tidy(P.compare_fingerprints(*sides, ["event_type"]))


@query(
    "size_outliers_3sigma",
    """WITH s AS (SELECT l_returnflag, avg(l_extendedprice) + 2 * stddev_samp(l_extendedprice) AS threshold FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, round(threshold, 4) AS threshold FROM lineitem JOIN s USING (l_returnflag) WHERE l_extendedprice > threshold""",
)
def size_outliers_3sigma(spark, folder):
    """Two deviations here, so that the flat test data has some."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return tidy(O.size_outliers(rows, "l_extendedprice", ["l_returnflag"], sigmas=2.0), 4)


@query(
    "timing_outliers_p99",
    """WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id)) / 1e6 AS time_delta FROM events),
t AS (SELECT quantile_cont(time_delta, 0.99) AS threshold FROM g)
SELECT event_id, round(time_delta, 4) AS time_delta, round(threshold, 4) AS threshold FROM g, t WHERE time_delta > threshold""",
)
def timing_outliers_p99(spark, folder):
    events = table(spark, folder, "events").select(F.lit("all").alias("capture_id"), "event_id", "ts")
    rows = rolling_features(events, ["timing"], order="event_id")
    return tidy(O.timing_outliers(rows.select("event_id", "time_delta")), 4)


@query(
    "iqr_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL)
SELECT event_id, event_type, value, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high FROM events JOIN q USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def iqr_outliers(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return tidy(O.iqr_outliers(events, "value", ["event_type"], stored=True), 4)


@query(
    "deviation_bands",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL)
SELECT event_id, event_type, value, CASE WHEN abs(value - m) > 3 * sd THEN 'strong' WHEN abs(value - m) > 2 * sd THEN 'flag' ELSE 'normal' END AS severity
FROM events JOIN s USING (event_type)""",
)
def deviation_bands(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return tidy(O.deviation_bands(events, "value", ["event_type"]))


@query(
    "exact_quantiles",
    """SELECT o_orderpriority, 'o_totalprice' AS feature, p AS prob, round(CASE p WHEN 0.01 THEN quantile_cont(o_totalprice, 0.01) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5)
  WHEN 0.9 THEN quantile_cont(o_totalprice, 0.9) ELSE quantile_cont(o_totalprice, 1.0) END, 4) AS value
FROM orders, (SELECT unnest([0.01, 0.5, 0.9, 1.0]::DOUBLE[]) AS p) GROUP BY o_orderpriority, p""",
)
def exact_quantiles(spark, folder):
    from wiregrain.operators.quantiles import exact_quantiles as run

    orders = table(spark, folder, "orders")
    return tidy(run(orders, ["o_totalprice"], [0.01, 0.5, 0.9, 1.0], ["o_orderpriority"], stored=True), 4)


_LABELS_SQL = """lab AS (SELECT doc_id, 'cap' || (doc_id % 5) AS capture_id,
  CASE WHEN doc_id % 50 = 0 THEN 'odd' WHEN quality = 0 AND toxic = 0 THEN 'P3' WHEN quality = 0 THEN 'P2' WHEN toxic = 0 THEN 'N' ELSE 'P1' END AS label FROM labels)"""


@query(
    "class_distribution",
    f"""WITH {_LABELS_SQL}, k AS (SELECT unnest(['N', 'P1', 'P2', 'P3']) AS label, unnest([0, 1, 2, 3]) AS numeric_label),
c AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
SELECT k.label, k.numeric_label, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER () * 100, 6) AS percentage FROM k LEFT JOIN c ON k.label = c.label""",
)
def class_distribution(spark, folder):
    return tidy(G.class_distribution(labelled_documents(spark, folder)[1]))


@query(
    "class_distribution_pivot",
    f"""WITH {_LABELS_SQL}
SELECT lang AS protocol, count(*) FILTER (label = 'N') AS N, count(*) FILTER (label = 'P1') AS P1, count(*) FILTER (label = 'P2') AS P2, count(*) FILTER (label = 'P3') AS P3
FROM lab JOIN documents USING (doc_id) GROUP BY lang""",
)
def class_distribution_pivot(spark, folder):
    documents, labels = labelled_documents(spark, folder)
    rows = documents.join(labels, ["capture_id", "packet_number"]).withColumnRenamed("lang", "protocol")
    return G.class_by_protocol(rows)


@query(
    "protocol_counts",
    "SELECT source AS protocol, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percentage FROM documents GROUP BY source",
)
def protocol_counts(spark, folder):
    return tidy(G.protocol_counts(table(spark, folder, "documents").select(F.col("source").alias("protocol"))))
