"""Registered queries: a callable on (session, folder) and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Times are whole microseconds, so averages often end in an exact half, which two
# engines may round differently. Both sides add this before rounding.
SHIFT = 1.2345e-8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = _shift_rounds(sql.strip())
        return function

    return add


def _shift_rounds(sql: str) -> str:
    """Add ``SHIFT`` to the value of every two-argument ``round`` in the text."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        begin = found + len("round(")
        depth, comma, end = 1, None, begin
        while depth:
            char = sql[end]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = end
            end += 1
        inner_end = end - 1 if comma is None else comma
        inner = _shift_rounds(sql[begin:inner_end])
        value = inner if comma is None else f"({inner}) + {SHIFT!r}"
        out += [sql[at:begin], value, sql[inner_end:end]]
        at = end
    return "".join(out) + sql[at:]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, times as microseconds, so that engines can be compared."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "double":
            out.append(F.round(F.col(f.name) + SHIFT, digits).alias(f.name))
        elif kind == "timestamp":
            out.append(F.unix_micros(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- SQL building blocks ------------------------------------------------------------

EVENTS = """
ev AS (
  SELECT event_id, epoch_us(ts) AS us, ts, user_id, event_type, value, props,
         strftime(ts, '%Y-%m-%d') AS capture_id,
         event_type IN ('purchase', 'error') AS answer,
         '10.0.0.' || (user_id % 40) AS client_ip, '10.0.1.' || (user_id % 7) AS server_ip,
         40000 + user_id % 1000 AS client_port
  FROM events)"""

PACKETS = (
    EVENTS
    + """,
pk0 AS (
  SELECT *, event_id AS packet_number,
    CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 6 WHEN 'signup' THEN 23
         WHEN 'purchase' THEN 16 ELSE 131 END AS function_code,
    repeat(props, CAST(floor(value) AS BIGINT) % 23 + 1) AS data,
    user_id % 65536 AS transaction_id,
    CASE WHEN event_id % 33 = 0 THEN 7 ELSE 0 END AS protocol_id,
    user_id % 256 AS unit_id,
    CASE WHEN answer THEN server_ip ELSE client_ip END AS src_ip,
    CASE WHEN answer THEN client_ip ELSE server_ip END AS dst_ip,
    CASE WHEN answer THEN 502 ELSE client_port END AS src_port,
    CASE WHEN answer THEN client_port ELSE 502 END AS dst_port
  FROM ev),
pk AS (
  SELECT *, length(data) AS data_length, length(data) + 8 AS packet_length,
    length(data) + 2 + CASE WHEN event_id % 20 = 0 THEN 5 ELSE 0 END AS modbus_length,
    protocol_id = 0 AND function_code BETWEEN 1 AND 127 AS is_valid,
    CAST(function_code IN (1, 2, 3, 4) AS INTEGER) AS is_read_operation,
    CAST(function_code IN (5, 6, 15, 16) AS INTEGER) AS is_write_operation,
    CAST(function_code >= 128 AS INTEGER) AS is_error_response,
    CAST(protocol_id = 0 AS INTEGER) AS protocol_id_valid,
    CAST(unit_id BETWEEN 1 AND 247 AS INTEGER) AS unit_id_valid,
    CAST(function_code BETWEEN 1 AND 127 AS INTEGER) AS function_code_valid,
    CAST(event_id % 20 <> 0 AS INTEGER) AS length_consistent,
    CASE function_code WHEN 3 THEN 'Read Holding Registers' WHEN 6 THEN 'Write Single Register'
      WHEN 23 THEN 'Read/Write Multiple Registers' WHEN 16 THEN 'Write Multiple Registers'
      ELSE 'Error Response (Exception Code: 3)' END AS function_name
  FROM pk0)"""
)

# Byte entropy of the data, header and full packet of every packet.
ENTROPY = """,
hexed AS (
  SELECT packet_number,
    printf('%04X%04X%04X%02X%02X', transaction_id, protocol_id, modbus_length, unit_id, function_code) AS head,
    hex(encode(data)) AS body
  FROM pk),
spread AS (
  SELECT packet_number, 'payload' AS part, unnest(range(1, length(body), 2)) AS i, body AS h FROM hexed
  UNION ALL
  SELECT packet_number, 'header', unnest(range(1, 14, 2)), head FROM hexed
  UNION ALL
  SELECT packet_number, 'full', unnest(range(1, length(head || body), 2)), head || body FROM hexed),
counted AS (
  SELECT packet_number, part, substr(h, i, 2) AS b, count(*) AS c FROM spread GROUP BY ALL),
shares AS (
  SELECT packet_number, part, c / sum(c) OVER (PARTITION BY packet_number, part) AS p FROM counted),
ent AS (
  SELECT packet_number,
    coalesce(-sum(p * log2(p)) FILTER (part = 'payload'), 0) AS payload_entropy,
    coalesce(-sum(p * log2(p)) FILTER (part = 'header'), 0) AS header_entropy,
    coalesce(-sum(p * log2(p)) FILTER (part = 'full'), 0) AS full_packet_entropy
  FROM shares GROUP BY packet_number),
pe AS (SELECT pk.*, ent.* EXCLUDE (packet_number) FROM pk JOIN ent USING (packet_number))"""

# Rolling ten-packet features per capture over `pe`.
ROLLING = """,
gaps AS (
  SELECT *, (us - lag(us) OVER w) / 1e6 AS time_delta,
    1 - coalesce(CAST(function_code = lag(function_code) OVER w AS INTEGER), 0) AS function_code_changes
  FROM pe WINDOW w AS (PARTITION BY capture_id ORDER BY packet_number)),
roll AS (
  SELECT *, time_delta * 1000 AS time_delta_ms,
    avg(time_delta) OVER w AS time_delta_mean_10, stddev_samp(time_delta) OVER w AS time_delta_std_10,
    min(time_delta) OVER w AS time_delta_min_10, max(time_delta) OVER w AS time_delta_max_10,
    avg(packet_length) OVER w AS packet_length_mean_10, stddev_samp(packet_length) OVER w AS packet_length_std_10,
    min(packet_length) OVER w AS packet_length_min_10, max(packet_length) OVER w AS packet_length_max_10,
    avg(payload_entropy) OVER w AS payload_entropy_mean_10, stddev_samp(payload_entropy) OVER w AS payload_entropy_std_10,
    min(payload_entropy) OVER w AS payload_entropy_min_10, max(payload_entropy) OVER w AS payload_entropy_max_10,
    1 - avg(function_code_changes) OVER w AS function_code_stability_10,
    sum(CAST(coalesce(time_delta * 1000 < 1.0, false) AS INTEGER)) OVER w AS burst_streak
  FROM gaps WINDOW w AS (PARTITION BY capture_id ORDER BY packet_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
