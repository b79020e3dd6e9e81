"""Decoding, flags, entropy and the whole feature chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain.functions.entropy import classify_entropy, is_entropy_normal, shannon_entropy
from wiregrain.operators import decode as D
from wiregrain.operators import features as X
from wiregrain.operators.detect import packet_ml_features
from wiregrain.operators.distributions import entropy_classes
from wiregrain.operators.stats import entropy_statistics
from wiregrain.plans.queries.registry import ENTROPY, EVENTS, PACKETS, ROLLING, query, tidy
from wiregrain.plans.tables import dnp3_packets, modbus_packets, table
from wiregrain.session import settle
from wiregrain.sources.sinks import combine

ID = ["capture_id", "packet_number"]


def modbus(spark, folder, keep_invalid=True):
    return D.decode(modbus_packets(spark, folder), D.MODBUS, keep_invalid)


def dnp3(spark, folder, keep_invalid=True):
    return D.decode(dnp3_packets(spark, folder), D.DNP3, keep_invalid)


def narrow(spark, folder, *columns):
    """Decoded columns, stored once for operators that read them more than once."""
    return settle(modbus(spark, folder).select(*ID, *columns))


def modbus_features(spark, folder, keep_invalid=True):
    return X.all_features(modbus(spark, folder, keep_invalid), D.MODBUS)


@query(
    "header_decode_modbus",
    f"""WITH {PACKETS}
SELECT capture_id, packet_number, transaction_id, protocol_id, modbus_length, unit_id, function_code,
  function_name, packet_length, data_length, hex(encode(data)) AS data_hex, is_valid
FROM pk""",
)
def header_decode_modbus(spark, folder):
    return modbus(spark, folder).select(
        *ID,
        "transaction_id",
        "protocol_id",
        "modbus_length",
        "unit_id",
        "function_code",
        "function_name",
        "packet_length",
        "data_length",
        F.hex("data").alias("data_hex"),
        "is_valid",
    )


_DNP3 = (
    EVENTS
    + """,
dp AS (
  SELECT capture_id, event_id AS packet_number, event_id % 65536 AS transaction_id, 0 AS protocol_id,
    length(props) + 4 + event_id % 5 AS modbus_length, user_id % 65536 AS unit_id,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 129 ELSE 0 END AS function_code,
    CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'WRITE' WHEN 'signup' THEN 'DIRECT_OPERATE' WHEN 'purchase' THEN 'RESPONSE' ELSE 'CONFIRM' END AS function_name,
    length(props) + 13 AS packet_length, length(props) + 2 AS data_length,
    user_id % 32 AS app_function_code, event_id % 16 AS app_sequence,
    (event_id % 256) // 128 AS app_first, (event_id % 128) // 64 AS app_final, event_id
  FROM ev)"""
)


@query(
    "header_decode_dnp3",
    f"""WITH {_DNP3}
SELECT capture_id, packet_number, transaction_id, protocol_id, modbus_length, unit_id, function_code,
  function_name, packet_length, data_length, app_function_code, app_sequence, app_first, app_final, true AS is_valid
FROM dp""",
)
def header_decode_dnp3(spark, folder):
    return dnp3(spark, folder).select(
        *ID,
        "transaction_id",
        "protocol_id",
        "modbus_length",
        "unit_id",
        "function_code",
        "function_name",
        "packet_length",
        "data_length",
        "app_function_code",
        "app_sequence",
        "app_first",
        "app_final",
        "is_valid",
    )


@query(
    "dnp3_flags",
    f"""WITH {_DNP3}
SELECT capture_id, packet_number, CAST(function_code = 1 AS INTEGER) AS is_read_operation,
  CAST(function_code IN (2, 4, 5) AS INTEGER) AS is_write_operation, CAST(function_code >= 128 AS INTEGER) AS is_error_response,
  1 AS protocol_id_valid, 1 AS unit_id_valid, 1 AS function_code_valid,
  CAST(abs(modbus_length - data_length) <= 5 AS INTEGER) AS length_consistent
FROM dp""",
)
def dnp3_flags(spark, folder):
    rows = dnp3(spark, folder).transform(X.operation_flags, D.DNP3).transform(X.validation_flags, D.DNP3)
    return rows.select(
        *ID,
        "is_read_operation",
        "is_write_operation",
        "is_error_response",
        "protocol_id_valid",
        "unit_id_valid",
        "function_code_valid",
        "length_consistent",
    )


@query(
    "basic_features",
    f"""WITH {PACKETS}
SELECT capture_id, packet_number, round(us / 1e6, 6) AS "timestamp", src_ip, dst_ip, src_port, dst_port, transaction_id,
  protocol_id, unit_id, function_code, function_name, packet_length, modbus_length, data_length, is_valid
FROM pk WHERE is_valid""",
)
def basic_features(spark, folder):
    return tidy(D.basic_features(modbus(spark, folder, keep_invalid=False)))


@query(
    "packet_records",
    f"""WITH {PACKETS}
SELECT packet_number, CAST(unit_id AS VARCHAR) AS unit_id, CAST(modbus_length AS VARCHAR) AS length, src_ip,
  CASE WHEN is_valid THEN 'true' ELSE 'false' END AS is_valid FROM pk""",
)
def packet_records(spark, folder):
    records = D.packet_records(modbus(spark, folder))
    picks = [F.get_json_object("record", f"$.{c}").alias(c) for c in ("unit_id", "length", "src_ip", "is_valid")]
    return records.select("packet_number", *picks)


@query(
    "capture_audit",
    f"""WITH {PACKETS}
SELECT capture_id, count(*) AS frames, count(*) AS protocol_packets, count(*) FILTER (is_valid) AS valid_packets
FROM pk GROUP BY capture_id""",
)
def capture_audit(spark, folder):
    return D.capture_audit(modbus_packets(spark, folder), D.MODBUS)


@query(
    "function_code_filter",
    f"""WITH {PACKETS} SELECT capture_id, packet_number, function_code FROM pk WHERE is_valid AND function_code = 3""",
)
def function_code_filter(spark, folder):
    rows = D.with_function_code(modbus(spark, folder, keep_invalid=False), 3)
    return rows.select(*ID, "function_code")


@query("unique_function_codes", f"WITH {PACKETS} SELECT DISTINCT function_code FROM pk WHERE is_valid")
def unique_function_codes(spark, folder):
    return D.function_codes(modbus(spark, folder, keep_invalid=False))


@query(
    "validation_flags",
    f"""WITH {PACKETS} SELECT capture_id, packet_number, protocol_id_valid, unit_id_valid, function_code_valid, length_consistent FROM pk""",
)
def validation_flags(spark, folder):
    rows = X.validation_flags(modbus(spark, folder), D.MODBUS)
    return rows.select(*ID, "protocol_id_valid", "unit_id_valid", "function_code_valid", "length_consistent")


@query(
    "fc_one_hot",
    f"""WITH {PACKETS}
SELECT capture_id, packet_number, CAST(function_code = 3 AS INTEGER) AS fc_3, CAST(function_code = 6 AS INTEGER) AS fc_6,
  CAST(function_code = 16 AS INTEGER) AS fc_16, CAST(function_code = 23 AS INTEGER) AS fc_23, CAST(function_code = 131 AS INTEGER) AS fc_131
FROM pk""",
)
def fc_one_hot(spark, folder):
    rows = X.one_hot(modbus(spark, folder).select(*ID, "function_code"))
    return rows.drop("function_code")


@query(
    "packet_entropy",
    f"""WITH {PACKETS}{ENTROPY}
SELECT capture_id, packet_number, round(payload_entropy, 6) AS payload_entropy, round(header_entropy, 6) AS header_entropy,
  round(full_packet_entropy, 6) AS full_packet_entropy,
  CASE WHEN payload_entropy < 2 THEN 'Very Low (Highly repetitive)' WHEN payload_entropy < 4 THEN 'Low (Structured data)'
    WHEN payload_entropy < 6 THEN 'Medium (Mixed content)' WHEN payload_entropy < 7 THEN 'High (Varied data)'
    ELSE 'Very High (Random/Encrypted)' END AS entropy_classification,
  payload_entropy BETWEEN 3.5 AND 6.5 AS is_normal_entropy
FROM pe""",
)
def packet_entropy(spark, folder):
    rows = X.entropy_features(modbus(spark, folder), D.MODBUS)
    return tidy(
        rows.select(
            *ID,
            "payload_entropy",
            "header_entropy",
            "full_packet_entropy",
            "entropy_classification",
            "is_normal_entropy",
        )
    )


# Entropy of whole texts: bytes of the UTF-8 form, two hex digits each.
_TEXT_ENTROPY = """
hexed AS (SELECT {key}, hex(encode({text})) AS h FROM {table}),
bytes AS (SELECT {key}, substr(h, i, 2) AS b FROM (SELECT {key}, h, unnest(range(1, length(h), 2)) AS i FROM hexed)),
counted AS (SELECT {key}, b, count(*) AS c FROM bytes GROUP BY ALL),
shares AS (SELECT {key}, c / sum(c) OVER (PARTITION BY {key}) AS p FROM counted),
ent AS (SELECT {key}, -sum(p * log2(p)) AS entropy FROM shares GROUP BY {key})"""


@query(
    "entropy_payload",
    f"""WITH {_TEXT_ENTROPY.format(key='doc_id', text='text', table='documents')}
SELECT doc_id, round(coalesce(entropy, 0), 6) AS entropy,
  CASE WHEN coalesce(entropy, 0) < 2 THEN 'Very Low (Highly repetitive)' WHEN entropy < 4 THEN 'Low (Structured data)'
    WHEN entropy < 6 THEN 'Medium (Mixed content)' WHEN entropy < 7 THEN 'High (Varied data)'
    ELSE 'Very High (Random/Encrypted)' END AS entropy_class,
  coalesce(entropy, 0) BETWEEN 3.5 AND 6.5 AS is_normal
FROM documents LEFT JOIN ent USING (doc_id)""",
)
def entropy_payload(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", shannon_entropy(F.col("text")).alias("entropy"))
    return tidy(
        docs.select(
            "doc_id",
            "entropy",
            classify_entropy(F.col("entropy")).alias("entropy_class"),
            is_entropy_normal(F.col("entropy")).alias("is_normal"),
        )
    )


@query(
    "entropy_class_dist",
    f"""WITH {_TEXT_ENTROPY.format(key='page_id', text='html', table='pages')},
c AS (SELECT CASE WHEN coalesce(entropy, 0) < 2 THEN 'Very Low (Highly repetitive)' WHEN entropy < 4 THEN 'Low (Structured data)'
    WHEN entropy < 6 THEN 'Medium (Mixed content)' WHEN entropy < 7 THEN 'High (Varied data)'
    ELSE 'Very High (Random/Encrypted)' END AS entropy_classification FROM pages LEFT JOIN ent USING (page_id))
SELECT entropy_classification, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percentage
FROM c GROUP BY entropy_classification""",
)
def entropy_class_dist(spark, folder):
    pages = table(spark, folder, "pages").select(shannon_entropy(F.col("html")).alias("e"))
    return tidy(entropy_classes(pages.select(classify_entropy(F.col("e")).alias("entropy_classification"))))


@query(
    "entropy_stats",
    f"""WITH {_TEXT_ENTROPY.format(key='doc_id', text='text', table='documents')},
e AS (SELECT lang, coalesce(entropy, 0) AS entropy FROM documents LEFT JOIN ent USING (doc_id))
SELECT lang, round(avg(entropy), 6) AS mean, round(stddev_pop(entropy), 6) AS std, round(min(entropy), 6) AS min,
  round(max(entropy), 6) AS max, round(quantile_cont(entropy, 0.5), 6) AS median,
  round(quantile_cont(entropy, 0.25), 6) AS q25, round(quantile_cont(entropy, 0.75), 6) AS q75
FROM e GROUP BY lang""",
)
def entropy_stats(spark, folder):
    docs = table(spark, folder, "documents").select("lang", shannon_entropy(F.col("text")).alias("entropy"))
    return tidy(entropy_statistics(docs, "entropy", ["lang"]))


_FLOW_SQL = f"""WITH {PACKETS},
s AS (SELECT capture_id, src_ip, count(*) AS packets_per_src FROM pk GROUP BY ALL),
d AS (SELECT capture_id, dst_ip, count(*) AS packets_per_dst FROM pk GROUP BY ALL),
u AS (SELECT capture_id, unit_id, count(*) AS packets_per_unit FROM pk GROUP BY ALL),
q AS (SELECT capture_id, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
        count(DISTINCT unit_id) AS unique_unit_ids, count(*) AS n, max(us) - min(us) AS span,
        sum(is_read_operation) AS reads, sum(is_write_operation) AS writes FROM pk GROUP BY ALL)"""


@query(
    "flow_counts",
    f"""{_FLOW_SQL}
SELECT capture_id, packet_number, packets_per_src, packets_per_dst, packets_per_unit, unique_src_ips, unique_dst_ips, unique_unit_ids
FROM pk JOIN s USING (capture_id, src_ip) JOIN d USING (capture_id, dst_ip) JOIN u USING (capture_id, unit_id) JOIN q USING (capture_id)""",
)
def flow_counts(spark, folder):
    rows = narrow(spark, folder, "ts", "src_ip", "dst_ip", "unit_id", "function_code")
    counted = X.flow_features(X.operation_flags(rows, D.MODBUS))
    counts = [c for c in counted.columns if c.startswith(("packets_per", "unique"))]
    return counted.select(*ID, *counts)


_CHAIN_COLUMNS = [
    "function_code",
    "packet_length",
    "is_read_operation",
    "unit_id_valid",
    "length_consistent",
    "fc_3",
    "fc_23",
    "payload_entropy",
    "header_entropy",
    "full_packet_entropy",
    "time_delta_mean_10",
    "packet_length_std_10",
    "payload_entropy_max_10",
    "function_code_stability_10",
    "packets_per_src",
    "unique_unit_ids",
    "read_write_ratio",
    "traffic_intensity",
    "entropy_stability",
]


@query(
    "all_features",
    f"""{_FLOW_SQL}{ENTROPY}{ROLLING}
SELECT capture_id, packet_number, function_code, packet_length, is_read_operation, unit_id_valid, length_consistent,
  CAST(function_code = 3 AS INTEGER) AS fc_3, CAST(function_code = 23 AS INTEGER) AS fc_23,
  round(payload_entropy, 4) AS payload_entropy, round(header_entropy, 4) AS header_entropy, round(full_packet_entropy, 4) AS full_packet_entropy,
  round(time_delta_mean_10, 4) AS time_delta_mean_10, round(packet_length_std_10, 4) AS packet_length_std_10,
  round(payload_entropy_max_10, 4) AS payload_entropy_max_10, round(function_code_stability_10, 4) + 0.0 AS function_code_stability_10,
  packets_per_src, unique_unit_ids, round(reads / greatest(writes, 1), 4) AS read_write_ratio,
  round(n / greatest(span / 1e6, 1), 4) AS traffic_intensity, round(1 / (1 + coalesce(payload_entropy_std_10, 0)), 4) AS entropy_stability
FROM roll JOIN s USING (capture_id, src_ip) JOIN q USING (capture_id)""",
)
def all_features(spark, folder):
    return tidy(modbus_features(spark, folder).select(*ID, *_CHAIN_COLUMNS), 4)


@query(
    "derived_features",
    f"""{_FLOW_SQL}
SELECT capture_id, packet_number, round(reads / greatest(writes, 1), 6) AS read_write_ratio,
  round(n / greatest(span / 1e6, 1), 6) AS traffic_intensity
FROM pk JOIN q USING (capture_id)""",
)
def derived_features(spark, folder):
    rows = narrow(spark, folder, "ts", "src_ip", "dst_ip", "unit_id", "function_code")
    rows = X.operation_flags(rows, D.MODBUS)
    return tidy(X.derived_features(rows).select(*ID, "read_write_ratio", "traffic_intensity"))


@query(
    "feature_matrix",
    f"""WITH {PACKETS}{ENTROPY}{ROLLING}
SELECT capture_id, packet_number, round(coalesce(time_delta, 0), 4) AS time_delta,
  round(coalesce(packet_length_std_10, 0), 4) AS packet_length_std_10, CAST(is_valid AS DOUBLE) AS is_valid,
  round(coalesce(time_delta, 0) + coalesce(packet_length_std_10, 0) + CAST(is_valid AS DOUBLE), 4) AS vector_sum
FROM roll""",
)
def feature_matrix(spark, folder):
    from pyspark.ml.functions import vector_to_array

    from wiregrain.operators.windows import rolling_features

    rows = narrow(spark, folder, "ts", "packet_length", "is_valid")
    rows = rolling_features(rows, ["timing", "size"])
    matrix = X.feature_matrix(rows, ["time_delta", "packet_length_std_10", "is_valid"])
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return tidy(matrix.withColumn("vector_sum", total).drop("features"), 4)


@query(
    "normalised",
    """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / sd, 6) + 0.0 AS o_totalprice_z, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice_scaled,
  round(ln(1 + o_totalprice), 6) AS o_totalprice_log
FROM orders, s""",
)
def normalised(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    c = ["o_totalprice"]
    return tidy(X.normalise(orders, zscore=c, minmax=c, log=c).drop("o_totalprice"))


@query(
    "fill_missing",
    """WITH gappy AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN event_id % 4 = 0 THEN value END AS b,
    CASE WHEN event_id % 5 = 0 THEN value END AS c FROM events)
SELECT event_id, event_type,
  round(coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 6) AS a,
  round(coalesce(b, 0), 6) AS b, round(coalesce(c, avg(c) OVER ()), 6) AS c
FROM gappy""",
)
def fill_missing(spark, folder):
    value = F.col("value")
    rows = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        *[F.when(F.col("event_id") % n == 0, value).alias(c) for n, c in ((3, "a"), (4, "b"), (5, "c"))],
    )
    filled = X.fill_missing(
        rows,
        forward=["a"],
        zero=["b"],
        mean=["c"],
        keys=["event_type"],
        order="event_id",
    )
    return tidy(filled)


@query(
    "ml_features",
    f"""WITH {PACKETS}
SELECT capture_id, packet_number, packet_length + 54 AS packet_size, packet_length + 40 AS ip_len, src_port, dst_port, 1 AS is_tcp, 0 AS is_udp,
  round(coalesce((us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_number)) / 1e6, 0), 6) AS inter_arrival_time,
  1 AS is_modbus, function_code AS mb_func_code, CAST(NOT answer AND function_code = 3 AS INTEGER) AS mb_read_coils,
  CAST(NOT answer AND function_code = 6 AS INTEGER) AS mb_write_reg, 0 AS is_dnp3, -2 AS dnp3_func_code, -1 AS dnp3_app_seq, -1 AS dnp3_app_fir, -1 AS dnp3_app_fin
FROM pk""",
)
def ml_features(spark, folder):
    from wiregrain.operators.detect import FEATURES

    return tidy(packet_ml_features(modbus_packets(spark, folder)).select(*ID, *FEATURES))


@query(
    "ml_features_dnp3",
    f"""WITH {_DNP3}
SELECT capture_id, packet_number, 0 AS is_modbus, -2 AS mb_func_code, 1 AS is_dnp3, app_function_code AS dnp3_func_code,
  app_sequence AS dnp3_app_seq, app_first AS dnp3_app_fir, app_final AS dnp3_app_fin FROM dp""",
)
def ml_features_dnp3(spark, folder):
    rows = packet_ml_features(dnp3_packets(spark, folder))
    return rows.select(
        *ID, "is_modbus", "mb_func_code", "is_dnp3", "dnp3_func_code", "dnp3_app_seq", "dnp3_app_fir", "dnp3_app_fin"
    )


@query(
    "feature_union",
    f"""WITH {PACKETS}, u AS (SELECT capture_id, packet_number, CAST(function_code = 3 AS INTEGER) AS fc_3, 0 AS fc_6 FROM pk WHERE NOT answer
UNION ALL SELECT capture_id, packet_number, 0, CAST(function_code = 6 AS INTEGER) FROM pk WHERE answer)
SELECT capture_id, packet_number, fc_3, fc_6 FROM u""",
)
def feature_union(spark, folder):
    rows = modbus(spark, folder)
    out = rows.where(F.col("dst_port") == 502).select(*ID, "function_code")
    back = rows.where(F.col("src_port") == 502).select(*ID, "function_code")
    frames = [X.one_hot(out, [3]), X.one_hot(back, [6])]
    return combine(frames).dropDuplicates(ID).drop("function_code")
