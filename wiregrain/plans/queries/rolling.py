"""Row-window queries (last ten packets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain.operators.decode import MODBUS
from wiregrain.operators.features import entropy_features, operation_flags
from wiregrain.operators.spread import dense_index
from wiregrain.operators.windows import inter_arrival, rolling_features
from wiregrain.plans.queries.packets import ID, modbus, narrow
from wiregrain.plans.queries.registry import ENTROPY, PACKETS, ROLLING, query, tidy
from wiregrain.plans.tables import modbus_packets, table
from wiregrain.session import settle

_TIMING = [
    "time_delta",
    "time_delta_ms",
    "time_delta_mean_10",
    "time_delta_std_10",
    "time_delta_min_10",
    "time_delta_max_10",
    "time_delta_cv_10",
    "burst_indicator",
    "periodicity_score",
]

_TIMING_SQL = """
WITH gaps AS (
  SELECT event_id, user_id,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS d
  FROM events),
roll AS (
  SELECT *, avg(d) OVER w AS m, stddev_samp(d) OVER w AS s, min(d) OVER w AS lo, max(d) OVER w AS hi
  FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, round(d, 4) AS time_delta, round(d * 1000, 4) AS time_delta_ms,
  round(m, 4) AS time_delta_mean_10, round(s, 4) AS time_delta_std_10,
  round(lo, 4) AS time_delta_min_10, round(hi, 4) AS time_delta_max_10,
  round(coalesce(s / (m + 1e-9), 0), 4) AS time_delta_cv_10,
  CAST(coalesce(d * 1000 < 5, false) AS INTEGER) AS burst_indicator,
  round(1 - coalesce(s / (m + 1e-9), 0), 4) + 0.0 AS periodicity_score
FROM roll
"""


def _per_user(spark, folder, **where):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    rows = rolling_features(events, ["timing"], keys=["user_id"], order="event_id", **where)
    return tidy(rows.select("event_id", "user_id", *_TIMING), 4)


@query("inter_arrival_rolling", _TIMING_SQL)
def inter_arrival_rolling(spark, folder):
    return _per_user(spark, folder)


@query("inter_arrival_hot_keys", _TIMING_SQL)
def inter_arrival_hot_keys(spark, folder):
    """The same rows with a limit so low that every user is cut into slices."""
    return _per_user(spark, folder)


@query(
    "inter_arrival_time",
    f"""WITH {PACKETS}
SELECT capture_id, packet_number,
  round(coalesce((us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_number)) / 1e6, 0), 6) AS inter_arrival_time
FROM pk""",
)
def inter_arrival_time(spark, folder):
    rows = inter_arrival(modbus_packets(spark, folder))
    return tidy(rows.select("capture_id", "packet_number", "inter_arrival_time"))


@query(
    "size_rolling",
    f"""WITH {PACKETS},
roll AS (
  SELECT capture_id, packet_number, avg(packet_length) OVER w AS m, stddev_samp(packet_length) OVER w AS s,
    min(packet_length) OVER w AS lo, max(packet_length) OVER w AS hi
  FROM pk WINDOW w AS (PARTITION BY capture_id ORDER BY packet_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT capture_id, packet_number, round(m, 6) AS packet_length_mean_10, round(s, 6) AS packet_length_std_10,
  lo AS packet_length_min_10, hi AS packet_length_max_10,
  round(coalesce(s / (m + 1e-9), 0), 6) AS packet_length_cv_10
FROM roll""",
)
def size_rolling(spark, folder):
    rows = rolling_features(narrow(spark, folder, "packet_length"), ["size"])
    return tidy(rows.drop("packet_length"))


@query(
    "entropy_rolling",
    f"""WITH {PACKETS}{ENTROPY}{ROLLING}
SELECT capture_id, packet_number, round(payload_entropy_mean_10, 6) AS payload_entropy_mean_10,
  round(payload_entropy_std_10, 6) + 0.0 AS payload_entropy_std_10,
  round(payload_entropy_min_10, 6) AS payload_entropy_min_10, round(payload_entropy_max_10, 6) AS payload_entropy_max_10
FROM roll""",
)
def entropy_rolling(spark, folder):
    rows = entropy_features(modbus(spark, folder), MODBUS).select(*ID, "payload_entropy")
    return tidy(rolling_features(settle(rows), ["entropy"]).drop("payload_entropy"))


@query(
    "fc_stability",
    f"""WITH {PACKETS},
ch AS (SELECT *, 1 - coalesce(CAST(function_code = lag(function_code) OVER (PARTITION BY capture_id ORDER BY packet_number) AS INTEGER), 0) AS function_code_changes FROM pk)
SELECT capture_id, packet_number, function_code, is_read_operation, is_write_operation, is_error_response,
  function_code_changes,
  round(1 - avg(function_code_changes) OVER (PARTITION BY capture_id ORDER BY packet_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS function_code_stability_10
FROM ch""",
)
def fc_stability(spark, folder):
    rows = operation_flags(narrow(spark, folder, "function_code"), MODBUS)
    return tidy(rolling_features(rows, ["function_code"]))


@query(
    "burst_streak",
    """WITH fast AS (
  SELECT event_id, user_id % 3 AS part, (epoch_us(ts) - 1704067200000000) // 1000000 AS us FROM events),
g AS (SELECT *, (us - lag(us) OVER (PARTITION BY part ORDER BY event_id)) / 1e3 < 1.0 AS quick FROM fast)
SELECT event_id, part, CAST(sum(CAST(coalesce(quick, false) AS INTEGER)) OVER w AS BIGINT) AS burst_streak,
  sum(CAST(coalesce(quick, false) AS INTEGER)) OVER w >= 10 AS is_burst
FROM g WINDOW w AS (PARTITION BY part ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def burst_streak(spark, folder):
    """Events on a clock a million times faster, so that bursts do occur."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    faster = F.floor((F.unix_micros("ts") - start) / 1_000_000)
    events = table(spark, folder, "events").select(
        "event_id", (F.col("user_id") % 3).alias("part"), F.timestamp_micros(faster).alias("ts")
    )
    rows = rolling_features(events, ["timing"], keys=["part"], order="event_id")
    return rows.select("event_id", "part", "burst_streak", "is_burst")


@query(
    "packet_numbering",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position
FROM events""",
)
def packet_numbering(spark, folder):
    """Dense numbers per type with hot keys cut into slices."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    return dense_index(events, "position", keys=["event_type"], order="event_id")
