"""Queries on what the flat test tables lack: NULL keys, real outliers, rows without a group, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain import constants as C
from wiregrain.operators import baseline as B
from wiregrain.operators import distributions as G
from wiregrain.operators import features as E
from wiregrain.operators import fingerprint as P
from wiregrain.operators import outliers as O
from wiregrain.operators import stats as S
from wiregrain.operators.decode import MODBUS
from wiregrain.plans.queries.packets import modbus
from wiregrain.plans.queries.registry import PACKETS, query, tidy
from wiregrain.plans.tables import table

_KINDS = "k AS (SELECT event_id, nullif(event_type, 'error') AS kind, value FROM events)"


def _kinds(spark, folder):
    """Events whose kind is NULL for one type."""
    kind = F.expr("nullif(event_type, 'error')").alias("kind")
    return table(spark, folder, "events").select("event_id", kind, "value")


@query(
    "entropy_stats_null_key",
    f"""WITH {_KINDS} SELECT kind, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM k GROUP BY kind""",
)
def entropy_stats_null_key(spark, folder):
    return tidy(S.entropy_statistics(_kinds(spark, folder), "value", ["kind"]))


@query(
    "size_outliers_null_key",
    f"""WITH {_KINDS}, s AS (SELECT kind, avg(value) + 2 * stddev_samp(value) AS threshold FROM k GROUP BY kind)
SELECT event_id, k.kind, value, round(threshold, 4) AS threshold FROM k JOIN s ON k.kind IS NOT DISTINCT FROM s.kind WHERE value > threshold""",
)
def size_outliers_null_key(spark, folder):
    return tidy(O.size_outliers(_kinds(spark, folder), "value", ["kind"], sigmas=2.0), 4)


@query(
    "text_size_outliers_3sigma",
    """WITH s AS (SELECT lang, avg(length(text)) + 3 * stddev_samp(length(text)) AS threshold FROM documents GROUP BY lang)
SELECT doc_id, d.lang, length(text) AS size, round(threshold, 4) AS threshold FROM documents d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang WHERE length(text) > threshold""",
)
def text_size_outliers_3sigma(spark, folder):
    """Texts longer than the mean of their language plus three deviations: the lengths are skewed."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("size"))
    return tidy(O.size_outliers(rows, "size", ["lang"]), 4)


@query(
    "group_fingerprint_null_groups",
    f"""WITH {_KINDS}, m AS (SELECT quantile_cont(value, 0.5) AS q FROM k)
SELECT kind, 'value' AS feature, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n, q AS threshold,
  count(*) FILTER (value < q) AS count_below, count(*) FILTER (value > q) AS count_above FROM k, m WHERE kind IS NOT NULL GROUP BY kind, q""",
)
def group_fingerprint_null_groups(spark, folder):
    """Rows without a group have no row of their own, but the median threshold is that of all rows."""
    stats = P.group_stats(_kinds(spark, folder), ["kind"], ["value"], with_thresholds=True)
    return tidy(P.stats_long(stats, ["kind"]), 4)


@query(
    "histogram_null_key",
    f"""WITH {_KINDS}, e AS (SELECT kind, min(value) AS lo, max(value) AS hi FROM k GROUP BY kind)
SELECT e.kind, count(*) AS n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM k JOIN e ON k.kind IS NOT DISTINCT FROM e.kind GROUP BY e.kind, lo, hi""",
)
def histogram_null_key(spark, folder):
    bins = G.histogram(_kinds(spark, folder), "value", 20, ["kind"])
    return tidy(bins.groupBy("kind").agg(F.sum("n").alias("n"), F.min("bin_lo").alias("lo"), F.max("bin_hi").alias("hi")))


@query(
    "top_code_of_all_rows",
    """WITH c AS (SELECT user_id, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 6 WHEN 'signup' THEN 23 END AS function_code FROM events),
g AS (SELECT user_id, function_code, count(*) AS n FROM c GROUP BY user_id, function_code),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY function_code IS NULL, n DESC, function_code) AS r,
  count(function_code) OVER (PARTITION BY user_id) AS d FROM g)
SELECT user_id, function_code AS top_code, CASE WHEN function_code IS NOT NULL THEN n END AS top_count,
  CASE WHEN function_code IS NOT NULL THEN round(n / total * 100, 6) END AS top_percentage, d AS function_diversity FROM r WHERE r = 1""",
)
def top_code_of_all_rows(spark, folder):
    """Rows without a known code count in the percentage."""
    code = F.when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 6).when(F.col("event_type") == "signup", 23)
    rows = table(spark, folder, "events").select("user_id", code.alias("function_code"))
    return tidy(S.most_common_code(rows, ["user_id"]))


@query(
    "one_hot_given_codes",
    "SELECT p_partkey, "
    + ", ".join(f"CAST(p_partkey % 400 = {c} AS INTEGER) AS slot_{c}" for c in range(300))
    + " FROM part",
)
def one_hot_given_codes(spark, folder):
    """Three hundred indicators: more than a byte's worth, so the codes are given."""
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 400).alias("slot"))
    return E.one_hot(rows, range(300), "slot", "slot").drop("slot")


def _criteria() -> str:
    """The criteria as SQL rows."""
    bound = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x} AS DOUBLE)"
    return ", ".join(f"('{n}', {bound(lo)}, {bound(hi)})" for n, lo, hi in C.MESSAGE_CRITERIA)


@query(
    "baseline_messages",
    f"""WITH {PACKETS}, f AS (SELECT capture_id, least(src_ip, dst_ip) AS a, greatest(src_ip, dst_ip) AS b, count(*) AS n, sum(protocol_id_valid) AS p, sum(unit_id_valid) AS u,
  sum(length_consistent) AS l, count(*) FILTER (function_code IN (1, 2, 3, 4, 5, 6, 15, 16, 23)) AS s, count(*) FILTER (dst_port = 502) AS asks,
  count(*) FILTER (src_port = 502) AS answers, min(us) AS t0, max(us) AS t1 FROM pk GROUP BY ALL),
m AS (SELECT capture_id, CAST(sum(p) / sum(n) AS DOUBLE) AS protocol_id_share, CAST(sum(u) / sum(n) AS DOUBLE) AS unit_id_share, CAST(sum(l) / sum(n) AS DOUBLE) AS length_share,
  CAST(sum(s) / sum(n) AS DOUBLE) AS standard_code_share, CAST(sum(asks) / nullif(sum(answers), 0) AS DOUBLE) AS request_response_ratio, CAST(avg(n) AS DOUBLE) AS packets_per_flow,
  CAST(avg((t1 - t0) / 1e6) AS DOUBLE) AS flow_duration_seconds, CAST(avg(asks / nullif(answers, 0)) AS DOUBLE) AS flow_symmetry,
  CAST((max(t1) - min(t0)) / 1e6 / 3600 AS DOUBLE) AS collection_hours, CAST(sum(n) AS DOUBLE) AS collection_packets FROM f GROUP BY capture_id),
o AS (SELECT * FROM m UNPIVOT INCLUDE NULLS (observed FOR criterion IN ({', '.join(n for n, _, _ in C.MESSAGE_CRITERIA)})))
SELECT o.capture_id, o.criterion, round(observed, 4) AS observed, low, high,
  CASE WHEN observed IS NOT NULL THEN coalesce(observed >= low, true) AND coalesce(observed <= high, true) END AS passed
FROM o JOIN (VALUES {_criteria()}) c(criterion, low, high) USING (criterion)""",
)
def baseline_messages(spark, folder):
    """Messages, flows and the collection against their expected ranges."""
    rows = E.validation_flags(modbus(spark, folder), MODBUS)
    return tidy(B.message_compliance(rows, MODBUS.port), 4)
