"""Flows, time windows, pairing and periodicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain import constants as C
from wiregrain.operators import baseline as B
from wiregrain.operators import flows as L
from wiregrain.operators import timewindows as T
from wiregrain.plans.queries.packets import modbus, narrow
from wiregrain.plans.queries.registry import EVENTS, PACKETS, query, tidy
from wiregrain.plans.tables import table


@query(
    "flow_metrics",
    f"""WITH {PACKETS},
f AS (SELECT *, CASE WHEN src_ip < dst_ip THEN 1 ELSE 0 END AS fwd, least(src_ip, dst_ip) AS ip_a, greatest(src_ip, dst_ip) AS ip_b,
  CASE WHEN src_ip < dst_ip THEN src_port ELSE dst_port END AS port_a, CASE WHEN src_ip < dst_ip THEN dst_port ELSE src_port END AS port_b FROM pk),
c AS (SELECT capture_id, ip_a, port_a, ip_b, port_b, function_code, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY capture_id, ip_a, port_a, ip_b, port_b ORDER BY n DESC, function_code) AS r FROM c)
SELECT f.capture_id, f.ip_a, f.port_a, f.ip_b, f.port_b, count(*) AS packets, round((max(us) - min(us)) / 1e6, 4) AS duration_seconds,
  CAST(sum(fwd) AS BIGINT) AS forward_packets, CAST(count(*) - sum(fwd) AS BIGINT) AS backward_packets,
  round(sum(fwd) / nullif(count(*) - sum(fwd), 0), 4) AS forward_backward_ratio, sum(fwd) > 0 AND sum(fwd) < count(*) AS is_bidirectional,
  any_value(t.function_code) AS dominant_fc, round(any_value(t.n) / count(*), 4) AS dominant_fc_share, count(DISTINCT f.function_code) AS fc_diversity
FROM f JOIN t ON f.capture_id = t.capture_id AND f.ip_a = t.ip_a AND f.port_a = t.port_a AND f.ip_b = t.ip_b AND f.port_b = t.port_b AND t.r = 1
GROUP BY f.capture_id, f.ip_a, f.port_a, f.ip_b, f.port_b""",
)
def flow_metrics(spark, folder):
    return tidy(L.flow_metrics(modbus(spark, folder)), 4)


@query(
    "iat_shape",
    """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS d FROM events),
a AS (SELECT user_id, avg(d) AS m, stddev_pop(d) AS s FROM g GROUP BY user_id)
SELECT user_id, count(d) AS intervals, round(avg(d) * 1000, 4) AS iat_mean_ms, round(stddev_samp(d) * 1000, 4) AS iat_std_ms,
  round(CASE WHEN any_value(s) > 0 THEN avg(power((d - m) / nullif(s, 0), 3)) END, 4) + 0.0 AS iat_skewness, round(stddev_samp(d) / avg(d), 4) AS iat_cv,
  round(max(d) / avg(d), 4) AS iat_max_over_mean, round(stddev_pop(d) / avg(d), 4) AS iat_jitter
FROM g JOIN a USING (user_id) GROUP BY user_id""",
)
def iat_shape(spark, folder):
    return tidy(L.iat_shape(table(spark, folder, "events"), ["user_id"], "event_id"), 4)


@query(
    "autocorrelation",
    """WITH g AS (SELECT event_type, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS d FROM events),
p AS (SELECT *, lag(d, 2) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM g)
SELECT event_type, count(*) AS pairs, round(corr(d, b), 6) + 0.0 AS autocorrelation, coalesce(corr(d, b) > 0.7, false) AS is_periodic
FROM p WHERE d IS NOT NULL AND b IS NOT NULL GROUP BY event_type""",
)
def autocorrelation(spark, folder):
    events = table(spark, folder, "events")
    return tidy(L.iat_autocorrelation(events, 2, ["event_type"], "event_id"))


@query(
    "fc_behaviour",
    f"""WITH {PACKETS},
ch AS (SELECT *, 1 - coalesce(CAST(function_code = lag(function_code) OVER (PARTITION BY unit_id ORDER BY packet_number) AS INTEGER), 0) AS c FROM pk),
st AS (SELECT *, 1 - avg(c) OVER (PARTITION BY unit_id ORDER BY packet_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM ch)
SELECT unit_id, count(*) AS packets, round(avg(c), 6) AS fc_change_share, round(avg(s), 6) + 0.0 AS fc_stability FROM st GROUP BY unit_id""",
)
def fc_behaviour(spark, folder):
    return tidy(L.fc_behaviour(modbus(spark, folder), ["unit_id"]))


_PAIRS = f"""{PACKETS},
m AS (SELECT *, NOT answer AS is_request FROM pk),
p AS (SELECT q.capture_id, q.packet_number AS request_number, q.us,
   (SELECT min((r.us, r.packet_number)) FROM m r WHERE NOT r.is_request AND r.user_id % 40 = q.user_id % 40 AND r.capture_id = q.capture_id AND r.server_ip = q.server_ip
      AND (r.us, r.packet_number) > (q.us, q.packet_number) AND r.us - q.us <= 21600000000) AS hit
  FROM m q WHERE q.is_request)"""


@query(
    "request_response",
    f"""WITH {_PAIRS}
SELECT capture_id, request_number, hit[2] AS response_number, round((hit[1] - us) / 1000, 4) AS response_delay_ms FROM p""",
)
def request_response(spark, folder):
    pairs = _pairs(spark, folder)[1]
    return tidy(pairs.drop("client_ip", "server_ip"), 4)


def _pairs(spark, folder):
    columns = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "unit_id", "transaction_id"]
    messages = L.modbus_messages(narrow(spark, folder, *columns), 502)
    keys = ["capture_id", "client_ip", "server_ip"]
    # Short cells, so that answers often lie in the next one.
    return messages, L.pair_requests(messages, keys=keys, timeout_seconds=21600.0, cell_seconds=21600.0)


@query(
    "pairing_summary",
    f"""WITH {_PAIRS},
s AS (SELECT capture_id, count(*) FILTER (is_request) AS requests, count(*) FILTER (NOT is_request) AS responses FROM m GROUP BY ALL)
SELECT capture_id, any_value(requests) AS requests, any_value(responses) AS responses, count(*) FILTER (hit IS NULL) AS orphaned_requests,
  round(avg((hit[1] - us) / 1000), 4) AS mean_delay_ms, round(any_value(requests) / nullif(any_value(responses), 0), 4) AS request_response_ratio,
  round(count(*) FILTER (hit IS NULL) / any_value(requests), 4) AS orphan_share
FROM p JOIN s USING (capture_id) GROUP BY capture_id""",
)
def pairing_summary(spark, folder):
    return tidy(L.pairing_summary(*_pairs(spark, folder)), 4)


_STEPS = """l AS (SELECT *, lag(transaction_id) OVER w AS t1, lag(transaction_id, 2) OVER w AS t2 FROM m WHERE is_request
  WINDOW w AS (PARTITION BY capture_id, client_ip, server_ip ORDER BY packet_number)),
st AS (SELECT *, (transaction_id - t1 + 65536) % 65536 AS step, (t1 - t2 + 65536) % 65536 AS before FROM l),
rg AS (SELECT *, CASE WHEN step IS NOT NULL THEN step = 1 OR coalesce(step = before, false) END AS regular FROM st)"""


@query(
    "transaction_gaps",
    f"""WITH {PACKETS}, m AS (SELECT *, NOT answer AS is_request FROM pk), {_STEPS}
SELECT capture_id, client_ip, server_ip, count(*) AS requests, count(*) FILTER (NOT regular) AS gaps,
  CAST(coalesce(sum(CASE WHEN NOT regular THEN greatest(step - 1, 0) END), 0) AS BIGINT) AS skipped, round(avg(CAST(regular AS INTEGER)), 6) AS regular_id_share
FROM rg GROUP BY capture_id, client_ip, server_ip""",
)
def transaction_gaps(spark, folder):
    """Conversations of the tables have a new client port for every request, so addresses alone tell them apart."""
    keys = ["capture_id", "client_ip", "server_ip"]
    messages = L.modbus_messages(narrow(spark, folder, "src_ip", "dst_ip", "src_port", "dst_port", "transaction_id"), 502)
    return tidy(L.transaction_gaps(L.transaction_steps(messages, keys), keys))


def _conversation_criteria() -> str:
    bound = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"
    return ", ".join(f"('{n}', {bound(lo)}, {bound(hi)})" for n, lo, hi in C.CONVERSATION_CRITERIA)


@query(
    "baseline_conversations",
    f"""WITH {_PAIRS}, {_STEPS},
d AS (SELECT capture_id, avg((hit[1] - us) / 1000) AS mean, quantile_cont((hit[1] - us) / 1000, 0.95) AS p95, count(hit) AS matched, count(DISTINCT hit[2]) AS taken FROM p GROUP BY capture_id),
r AS (SELECT capture_id, avg(CAST(regular AS INTEGER)) AS share FROM rg GROUP BY capture_id),
i AS (SELECT capture_id, packet_number, (us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_number)) / 1e6 AS x FROM pk),
j AS (SELECT *, lag(x) OVER (PARTITION BY capture_id ORDER BY packet_number) AS y FROM i),
ac AS (SELECT capture_id, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c FROM j WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY capture_id),
e AS (SELECT capture_id, min(us) + max(us) AS twice, stddev_samp(packet_length) AS s, count(*) AS n FROM pk GROUP BY capture_id),
h AS (SELECT pk.capture_id, server_ip, unit_id, packet_length, 2 * us > twice AS late FROM pk JOIN e USING (capture_id)),
k AS (SELECT DISTINCT capture_id, server_ip, unit_id FROM h WHERE NOT late),
hm AS (SELECT h.capture_id, avg(CASE WHEN late THEN CAST(k.capture_id IS NOT NULL AS INTEGER) END) AS stable,
  abs(avg(packet_length) FILTER (late) - avg(packet_length) FILTER (NOT late)) AS drift FROM h LEFT JOIN k USING (capture_id, server_ip, unit_id) GROUP BY h.capture_id),
b AS (SELECT unit_id, avg(packet_length) AS a, 2 * stddev_samp(packet_length) AS w FROM pk GROUP BY unit_id HAVING count(*) >= 100),
cv AS (SELECT capture_id, avg(CAST(packet_length BETWEEN a - w AND a + w AS INTEGER)) AS share FROM pk JOIN b USING (unit_id) GROUP BY capture_id),
a AS (SELECT e.capture_id, mean AS response_delay_mean_ms, p95 AS response_delay_p95_ms, CAST((n - coalesce(matched, 0) - coalesce(taken, 0)) / n AS DOUBLE) AS orphan_packet_share,
  r.share AS regular_id_share, ac.c AS autocorrelation, stable AS mapping_stability, drift / nullif(s, 0) AS length_drift_sigma, cv.share AS coverage_share
  FROM e LEFT JOIN d USING (capture_id) LEFT JOIN r USING (capture_id) LEFT JOIN ac USING (capture_id) LEFT JOIN hm USING (capture_id) LEFT JOIN cv USING (capture_id)),
o AS (SELECT * FROM a UNPIVOT INCLUDE NULLS (observed FOR criterion IN ({', '.join(n for n, _, _ in C.CONVERSATION_CRITERIA)})))
SELECT o.capture_id, o.criterion, round(observed, 4) + 0.0 AS observed, low, high,
  CASE WHEN observed IS NOT NULL THEN coalesce(observed >= low, true) AND coalesce(observed <= high, true) END AS passed
FROM o JOIN (VALUES {_conversation_criteria()}) c(criterion, low, high) USING (criterion)""",
)
def baseline_conversations(spark, folder):
    """Conversations and the halves of the collection against their expected ranges."""
    pairing = {"keys": ["capture_id", "client_ip", "server_ip"], "timeout_seconds": 21600.0, "cell_seconds": 21600.0}
    return tidy(B.conversation_compliance(modbus(spark, folder), 502, **pairing), 4)


_WINDOWED = """count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
  count(DISTINCT unit_id) AS unique_unit_ids, count(DISTINCT function_code) AS unique_function_codes, count(*) FILTER (NOT is_valid) AS violations,
  round(avg(CAST(NOT is_valid AS INTEGER)), 6) AS violation_rate"""


@query(
    "sliding_60s",
    f"""WITH {PACKETS}, w AS (SELECT pk.*, (us // 10000000 - k) * 10000000 AS window_start FROM pk, (SELECT unnest(range(6)) AS k))
SELECT window_start, window_start + 60000000 AS window_end, {_WINDOWED} FROM w GROUP BY window_start""",
)
def sliding_60s(spark, folder):
    return tidy(T.window_metrics(modbus(spark, folder)))


@query(
    "tumbling_5m",
    f"""WITH {PACKETS} SELECT us // 300000000 * 300000000 AS window_start, us // 300000000 * 300000000 + 300000000 AS window_end, {_WINDOWED} FROM pk GROUP BY 1, 2""",
)
def tumbling_5m(spark, folder):
    return tidy(T.tumbling_metrics(modbus(spark, folder)))


@query(
    "window_codes",
    f"""WITH {PACKETS} SELECT us // 3600000000 * 3600000000 AS window_start, function_code, count(*) AS packets FROM pk GROUP BY ALL""",
)
def window_codes(spark, folder):
    return tidy(T.window_codes(modbus(spark, folder), "1 hour", None))


_SESSIONS = f"""{PACKETS},
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, packet_number) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM pk),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY us, packet_number ROWS UNBOUNDED PRECEDING) AS sid FROM g)"""


@query(
    "sessions",
    f"""WITH {_SESSIONS} SELECT src_ip, min(us) AS session_start, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes, round((max(us) - min(us)) / 1e6, 4) AS duration_seconds
FROM n GROUP BY src_ip, sid""",
)
def sessions(spark, folder):
    rows = narrow(spark, folder, "ts", "src_ip", "packet_length")
    return tidy(T.sessions(rows, ["src_ip"], "2 hours"), 4)


@query(
    "session_codes",
    f"""WITH {_SESSIONS}, c AS (SELECT src_ip, sid, function_code, min(us) AS us, count(*) AS n FROM n GROUP BY ALL)
SELECT src_ip, min(us) AS session_start, CAST(sum(n) AS BIGINT) AS packets, arg_min(function_code, -n * 1000 + function_code) AS dominant_fc FROM c GROUP BY src_ip, sid""",
)
def session_codes(spark, folder):
    rows = narrow(spark, folder, "ts", "src_ip", "function_code")
    return tidy(T.session_codes(rows, ["src_ip"], "2 hours"))


@query(
    "fft_periodicity",
    f"""WITH {EVENTS}, c AS (SELECT event_type, us // 600000000 AS tick, count(*) AS n FROM ev GROUP BY ALL),
s AS (SELECT event_type, tick // 512 AS segment, tick % 512 AS slot, n FROM c),
p AS (SELECT event_type, segment, f, sum(n * cos(2 * pi() * ((f * slot) % 512) / 512)) AS re, sum(n * sin(2 * pi() * ((f * slot) % 512) / 512)) AS im
  FROM s, (SELECT unnest(range(1, 257)) AS f) GROUP BY ALL),
w AS (SELECT event_type, f, sum(re * re + im * im) AS power FROM p GROUP BY ALL)
SELECT event_type, round(600.0 * 512 / arg_max(f, power), 6) AS dominant_period_seconds, round(max(power) / sum(power), 6) AS power_share FROM w GROUP BY event_type""",
)
def fft_periodicity(spark, folder):
    """Dominant period per event type; the SQL sums cosines and sines over the slots."""
    events = table(spark, folder, "events")
    return tidy(L.fft_periodicity(events, ["event_type"], bin_seconds=600.0, segment_bins=512))


@query(
    "packet_series",
    f"""WITH {EVENTS}, c AS (SELECT event_type, us // 600000000 AS tick, count(*) AS n FROM ev GROUP BY ALL)
SELECT event_type, tick // 512 AS segment, CAST(tick % 512 AS INTEGER) AS slot, n FROM c""",
)
def packet_series(spark, folder):
    return L.packet_series(table(spark, folder, "events"), ["event_type"], 600.0, 512)
