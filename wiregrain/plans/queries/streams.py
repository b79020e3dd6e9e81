"""Streaming queries, run over the events file as it lies; the SQL gives what has closed by then."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.operators import timewindows as W
from wiregrain.operators.detect import packet_fields, train_classifier
from wiregrain.plans.queries.registry import PACKETS, query, tidy
from wiregrain.plans.tables import modbus_packets
from wiregrain.session import Scratch
from wiregrain.streaming import jobs, rolling
from wiregrain.streaming.pairing import pair_stream
from wiregrain.streaming.sources import drop_repeats, packet_stream

_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def event_stream(spark, folder):
    """Events as a packet stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = packet_stream(spark, folder, schema=_EVENTS, pathGlobFilter="events.parquet")
    code = (
        F.when(F.col("event_type") == "view", 3)
        .when(F.col("event_type") == "click", 6)
        .when(F.col("event_type") == "signup", 23)
        .when(F.col("event_type") == "purchase", 16)
        .otherwise(131)
    )
    return raw.select(
        F.lit("events").alias("capture_id"),
        F.col("event_id").alias("packet_number"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        (F.col("user_id") % 256).alias("unit_id"),
        code.alias("function_code"),
        F.floor("value").alias("packet_length"),
        (code < 128).alias("is_valid"),
        "user_id",
        "event_type",
    )


# With one file the watermark ends at the newest event less the allowed delay.
_CLOSED = "(SELECT max(epoch_us(ts)) FROM events) - 120000000"


_WINDOW = """count(*) AS packets, CAST(sum(floor(value)) AS BIGINT) AS bytes,
  count(DISTINCT user_id) AS unique_src_ips, count(DISTINCT event_type) AS unique_dst_ips, count(DISTINCT user_id % 256) AS unique_unit_ids,
  count(DISTINCT CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase') THEN event_type ELSE 'error' END) AS unique_function_codes,
  count(*) FILTER (event_type = 'error') AS violations, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS violation_rate"""


@query(
    "stream_tumbling_5m",
    f"""WITH w AS (SELECT epoch_us(ts) // 300000000 * 300000000 AS window_start, * FROM events)
SELECT window_start, window_start + 300000000 AS window_end, {_WINDOW}
FROM w GROUP BY window_start HAVING window_start + 300000000 <= {_CLOSED}""",
)
def stream_tumbling_5m(spark, folder):
    return tidy(jobs.run_available(W.tumbling_metrics(event_stream(spark, folder), late="2 minutes")))


@query(
    "stream_sliding_60s",
    f"""WITH w AS (SELECT (epoch_us(ts) // 10000000 - k) * 10000000 AS window_start, events.* FROM events, (SELECT unnest(range(6)) AS k))
SELECT window_start, window_start + 60000000 AS window_end, {_WINDOW}
FROM w GROUP BY window_start HAVING window_start + 60000000 <= {_CLOSED}""",
)
def stream_sliding_60s(spark, folder):
    return tidy(jobs.run_available(W.window_metrics(event_stream(spark, folder), late="2 minutes")))


@query(
    "stream_session_codes",
    f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh, event_id,
  CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 6 WHEN 'signup' THEN 23 WHEN 'purchase' THEN 16 ELSE 131 END AS fc FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
c AS (SELECT user_id, sid, fc, min(us) AS us, max(us) AS last, count(*) AS k FROM n GROUP BY ALL)
SELECT user_id, min(us) AS session_start, CAST(sum(k) AS BIGINT) AS packets, arg_min(fc, -k * 1000 + fc) AS dominant_fc
FROM c GROUP BY user_id, sid HAVING max(last) + 7200000000 <= {_CLOSED}""",
)
def stream_session_codes(spark, folder):
    """Sessions of a user with the code that occurs most, from session state."""
    out = W.session_codes(event_stream(spark, folder), ["user_id"], "2 hours", late="2 minutes")
    return tidy(jobs.run_available(out))


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh, event_id, value FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(us) AS session_start, count(*) AS packets, CAST(sum(floor(value)) AS BIGINT) AS bytes, round((max(us) - min(us)) / 1e6, 4) AS duration_seconds
FROM n GROUP BY user_id, sid HAVING max(us) + 7200000000 <= {_CLOSED}""",
)
def stream_sessions(spark, folder):
    out = jobs.run_available(W.sessions(event_stream(spark, folder), ["user_id"], "2 hours", late="2 minutes"))
    return tidy(out, 4)


@query("stream_deduplicated", "SELECT event_id AS packet_number FROM events")
def stream_deduplicated(spark, folder):
    """Every event sent twice, kept once."""
    twice = event_stream(spark, folder).select(
        "capture_id", "packet_number", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    )
    return jobs.run_available(drop_repeats(twice)).select("packet_number")


@query(
    "stream_rolling",
    """WITH g AS (SELECT event_type, event_id, floor(value) AS len, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS d FROM events)
SELECT event_type, event_id AS packet_number, round(d, 4) AS time_delta, round(avg(d) OVER w, 4) AS time_delta_mean_10, round(stddev_samp(d) OVER w, 4) AS time_delta_std_10,
  round(avg(len) OVER w, 4) AS packet_length_mean_10, round(stddev_samp(len) OVER w, 4) AS packet_length_std_10
FROM g WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def stream_rolling(spark, folder):
    """Last ten packets per event type, from keyed state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    out = jobs.run_available(rolling.rolling_stream(event_stream(spark, folder), ["event_type"]))
    return tidy(
        out.select(
            "event_type",
            "packet_number",
            "time_delta",
            "time_delta_mean_10",
            "time_delta_std_10",
            "packet_length_mean_10",
            "packet_length_std_10",
        ),
        4,
    )


@query(
    "stream_pairs",
    """WITH q AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'view' AS asks FROM events WHERE event_type IN ('view', 'click')),
p AS (SELECT a.user_id, a.event_id AS request_number, a.us, arg_min(b.event_id, (b.us, b.event_id)) AS response_number, min(b.us) AS reply
  FROM q a LEFT JOIN q b ON NOT b.asks AND b.user_id = a.user_id AND b.us BETWEEN a.us AND a.us + 86400000000 WHERE a.asks GROUP BY ALL)
SELECT user_id, request_number, response_number, round((reply - us) / 1000, 4) AS response_delay_ms FROM p
WHERE (us + 86400000000 + 999999) // 1000000 * 1000000 < ((SELECT max(us) FROM q) - 120000000) // 1000 * 1000""",
)
def stream_pairs(spark, folder):
    """Views as requests and clicks as responses of the same user within a day, from keyed state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    events = event_stream(spark, folder).where(F.col("event_type").isin("view", "click"))
    messages = events.withColumn("is_request", F.col("event_type") == "view")
    return tidy(jobs.run_available(pair_stream(messages, ["user_id"], timeout="1 day")), 4)


@query(
    "stream_scores",
    f"""WITH {PACKETS}, g AS (
  SELECT capture_id, packet_number, function_code, dst_port, event_type, (us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_number)) / 1e6 AS gap FROM pk)
SELECT capture_id, packet_number, function_code AS mb_func_code, CAST(dst_port = 502 AND function_code = 6 AS INTEGER) AS mb_write_reg,
  round(coalesce(gap, 0), 6) AS inter_arrival_time, CASE event_type WHEN 'click' THEN 'P1' WHEN 'purchase' THEN 'P2' ELSE 'P3' END AS prediction
FROM g WHERE event_type IN ('click', 'purchase', 'error')""",
)
def stream_scores(spark, folder):
    """Alerts of a packet stream: features from keyed state, a tree that was taught a rule of the code, the alert sink."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    base = Scratch(spark, "stream").path
    packets = modbus_packets(spark, folder)
    packets.write.parquet(f"{base}/packets")
    rule = F.when(F.col("mb_func_code") == 6, 1).when(F.col("mb_func_code") == 16, 2).when(F.col("mb_func_code") == 131, 3).otherwise(0)
    train = packet_fields(spark.read.schema(packets.schema).parquet(f"{base}/packets"))
    columns = ["mb_func_code", "mb_write_reg", "src_port", "dst_port"]
    train = train.withColumn("numeric_label", rule)
    model = train_classifier(train, columns, numTrees=1, featureSubsetStrategy="all", bootstrap=False)
    stream = packet_stream(spark, f"{base}/packets", schema=packets.schema)
    alerts = jobs.score_stream(model, jobs.ml_feature_stream(stream), columns)
    running = (
        alerts.writeStream.foreachBatch(jobs.alert_writer(f"{base}/alerts"))
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    out = spark.read.schema(alerts.schema).parquet(f"{base}/alerts")
    return tidy(out.select("capture_id", "packet_number", "mb_func_code", "mb_write_reg", "inter_arrival_time", "prediction"))
