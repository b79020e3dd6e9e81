"""Attack-event analytics, label joins and label files."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiregrain.operators import attacks as A
from wiregrain.operators import labels as L
from wiregrain.plans.queries.registry import query, tidy
from wiregrain.plans.queries.statistics import _LABELS_SQL
from wiregrain.plans.tables import attack_events, labelled_documents, scored_events, table
from wiregrain.sources.labels import explode_labels
from wiregrain.sources.logs import attack_events as parse_log
from wiregrain.sources.sinks import label_documents

_ATTACKS = """atk AS (
  SELECT event_id, ts, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS capture_id, '192.168.1.' || (user_id % 45) AS source_ip, user_id % 45 AS octet,
    ['P1_APT', 'P2_Insider', 'P3_Opportunistic', 'P9_Unknown'][user_id % 4 + 1] AS attacker_profile_id,
    CASE event_type WHEN 'view' THEN 'Reconnaissance' WHEN 'error' THEN 'Availability' ELSE 'Integrity' END AS attack_category,
    CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 6 WHEN 'signup' THEN 16 WHEN 'purchase' THEN 15 ELSE 43 END AS modbus_fc_used,
    40001 + user_id % 6 AS target_register_address, CAST(floor(value) AS INTEGER) AS injected_value, event_id % 65536 AS transaction_id
  FROM events),
av AS (SELECT *, NOT CASE attacker_profile_id WHEN 'P1_APT' THEN octet BETWEEN 10 AND 19 WHEN 'P2_Insider' THEN octet BETWEEN 20 AND 29
    WHEN 'P3_Opportunistic' THEN octet BETWEEN 30 AND 39 ELSE false END AS bad_ip,
  CASE target_register_address WHEN 40001 THEN NOT injected_value BETWEEN 10 AND 50 WHEN 40002 THEN NOT injected_value BETWEEN 20 AND 60
    WHEN 40003 THEN NOT injected_value BETWEEN 5 AND 30 WHEN 40005 THEN NOT injected_value BETWEEN 0 AND 100 ELSE false END AS bad_value FROM atk)"""


@query("events_by_profile", f"WITH {_ATTACKS} SELECT attacker_profile_id, count(*) AS n FROM atk GROUP BY ALL")
def events_by_profile(spark, folder):
    return A.count_by(attack_events(spark, folder), "attacker_profile_id")


@query("events_by_category", f"WITH {_ATTACKS} SELECT attack_category, count(*) AS n FROM atk GROUP BY ALL")
def events_by_category(spark, folder):
    return A.count_by(attack_events(spark, folder), "attack_category")


@query(
    "fc_usage_grouping_sets",
    f"""WITH {_ATTACKS} SELECT attacker_profile_id, 'FC_' || modbus_fc_used AS fc_name, count(*) AS n, CAST(grouping(attacker_profile_id) AS INTEGER) AS is_total
FROM atk GROUP BY GROUPING SETS ((attacker_profile_id, 'FC_' || modbus_fc_used), ('FC_' || modbus_fc_used))""",
)
def fc_usage_grouping_sets(spark, folder):
    return A.function_code_usage(attack_events(spark, folder))


@query(
    "attribution_compliance",
    f"""WITH {_ATTACKS} SELECT attack_category, count(*) AS total_checked, count(*) FILTER (bad_ip) AS violations_found,
  round((count(*) - count(*) FILTER (bad_ip)) / count(*) * 100, 6) AS compliance_rate FROM av GROUP BY ALL""",
)
def attribution_compliance(spark, folder):
    return tidy(A.attribution_compliance(attack_events(spark, folder), ["attack_category"]))


@query(
    "attribution_violations",
    f"WITH {_ATTACKS} SELECT split_part(attacker_profile_id, '_', 1) AS profile, source_ip AS ip, transaction_id FROM av WHERE bad_ip",
)
def attribution_violations(spark, folder):
    return A.attribution_violations(attack_events(spark, folder)).drop("timestamp_utc")


@query(
    "process_check",
    f"""WITH {_ATTACKS} SELECT count(*) FILTER (attack_category = 'Integrity') AS integrity_events, count(*) FILTER (attack_category = 'Integrity' AND bad_value) AS violations,
  count(*) FILTER (attack_category = 'Integrity' AND bad_value) > 0 AS process_violation,
  round(count(*) FILTER (attack_category = 'Integrity' AND bad_value) / count(*) FILTER (attack_category = 'Integrity'), 6) AS process_violation_rate,
  count(*) FILTER (bad_ip) = 0 AS attribution_contract FROM av""",
)
def process_check(spark, folder):
    return tidy(A.process_check(attack_events(spark, folder)))


@query(
    "range_violation",
    """WITH r AS (SELECT 40000 + n_nationkey AS register, n_regionkey * 5 AS low, n_regionkey * 5 + 25 AS high FROM nation WHERE n_nationkey BETWEEN 1 AND 5)
SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS INTEGER) AS injected_value, coalesce(NOT l_quantity BETWEEN low AND high, false) AS violates
FROM lineitem LEFT JOIN r ON r.register = 40000 + l_linenumber""",
)
def range_violation(spark, folder):
    """Line items as register writes, ranges out of a dimension table."""
    nation = table(spark, folder, "nation").where(F.col("n_nationkey").between(1, 5))
    ranges = nation.select(
        (40000 + F.col("n_nationkey")).alias("register"),
        (F.col("n_regionkey") * 5).alias("low"),
        (F.col("n_regionkey") * 5 + 25).alias("high"),
    )
    writes = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("l_quantity").cast("int").alias("injected_value"),
        (40000 + F.col("l_linenumber")).alias("target_register_address"),
    )
    return A.range_violations(writes, ranges).drop("target_register_address", "register", "low", "high")


@query(
    "temporal_pattern",
    f"""WITH {_ATTACKS}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY attacker_profile_id ORDER BY us, event_id)) / 1e6 AS d FROM atk)
SELECT attacker_profile_id, count(*) AS events, min(us) AS first_attack, max(us) AS last_attack, round(avg(d), 4) AS mean_interval_seconds, round(stddev_pop(d), 4) AS std_interval_seconds,
  round(min(d), 4) AS min_interval_seconds, round(max(d), 4) AS max_interval_seconds, round((max(us) - min(us)) / 1e6, 4) AS total_duration_seconds,
  round(quantile_cont(d, 0.5), 4) AS median_interval_seconds
FROM g GROUP BY attacker_profile_id HAVING count(*) >= 2""",
)
def temporal_pattern(spark, folder):
    events = attack_events(spark, folder).select("attacker_profile_id", "event_id", "ts")
    return tidy(A.temporal_pattern(events, ["attacker_profile_id"], ["event_id"]), 4)


@query(
    "attack_log",
    f"""WITH {_ATTACKS} SELECT us AS ts, source_ip, transaction_id, attacker_profile_id, attack_category, modbus_fc_used, target_register_address, injected_value FROM atk""",
)
def attack_log(spark, folder):
    """Events written as log lines and parsed again."""
    record = F.to_json(F.struct(*[c for c in attack_events(spark, folder).columns if c not in ("ts", "event_id", "capture_id")]))
    lines = attack_events(spark, folder).select(F.concat(F.lit("2024-01-01 INFO ATTACK: "), record).alias("value"))
    return tidy(
        parse_log(lines).select(
            "ts",
            "source_ip",
            "transaction_id",
            "attacker_profile_id",
            "attack_category",
            "modbus_fc_used",
            "target_register_address",
            "injected_value",
        )
    )


@query(
    "detected_attacks",
    """WITH e AS (SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS capture_id, ['P1', 'P2', 'P3', 'P9'][user_id % 4 + 1] AS label FROM events),
p AS (SELECT epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS capture_id,
   ['N', 'P1', 'P2', 'P3'][CASE WHEN event_id % 7 >= 5 THEN (user_id % 4 + 1 + event_id % 3) % 4 ELSE user_id % 4 END + 1] AS prediction FROM events)
SELECT e.capture_id, event_id, label, count(p.us) AS detected_packets, count(p.us) > 0 AS detected
FROM e LEFT JOIN p ON p.capture_id = e.capture_id AND p.prediction = e.label AND p.prediction <> 'N' AND abs(p.us - e.us) <= 600000000
GROUP BY ALL""",
)
def detected_attacks(spark, folder):
    events = attack_events(spark, folder).select("capture_id", "event_id", "ts", "attacker_profile_id")
    return A.match_detections(scored_events(spark, folder), events, 600.0, 3600.0)


@query(
    "label_join",
    f"""WITH {_LABELS_SQL}
SELECT 'cap' || (d.doc_id % 5) AS capture_id, d.doc_id AS packet_number, n_chars, label,
  CASE label WHEN 'N' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 END AS numeric_label FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id""",
)
def label_join(spark, folder):
    documents, labels = labelled_documents(spark, folder)
    return L.label_packets(documents.drop("lang", "source"), labels)


@query(
    "labelled_only",
    f"""WITH {_LABELS_SQL} SELECT 'cap' || (doc_id % 5) AS capture_id, doc_id AS packet_number, label FROM documents JOIN lab USING (doc_id) WHERE label <> 'odd'""",
)
def labelled_only(spark, folder):
    documents, labels = labelled_documents(spark, folder)
    return L.labelled_only(L.label_packets(documents, labels)).select("capture_id", "packet_number", "label")


@query(
    "unlabelled_audit",
    f"""WITH {_LABELS_SQL}
SELECT 'cap' || (d.doc_id % 5) AS capture_id, count(*) AS packets, count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (label = 'odd') AS unmapped
FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id GROUP BY 1""",
)
def unlabelled_audit(spark, folder):
    return L.label_audit(*labelled_documents(spark, folder))


@query(
    "unlabelled_packets",
    "SELECT 'cap' || (doc_id % 5) AS capture_id, doc_id AS packet_number FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unlabelled_packets(spark, folder):
    documents, labels = labelled_documents(spark, folder)
    return L.unlabelled_packets(documents, labels).select("capture_id", "packet_number")


@query(
    "known_sources",
    f"""WITH {_LABELS_SQL} SELECT capture_id, doc_id AS packet_number, label FROM lab WHERE capture_id IN (SELECT 'cap' || (doc_id % 5) FROM documents WHERE doc_id % 5 < 3)""",
)
def known_sources(spark, folder):
    documents, labels = labelled_documents(spark, folder)
    return L.known_captures(labels, documents.where(F.col("packet_number") % 5 < 3))


@query(
    "label_documents",
    f"WITH {_LABELS_SQL} SELECT capture_id AS capture, doc_id AS packet_number, label FROM lab",
)
def label_file_round_trip(spark, folder):
    """Labels written as JSON documents and read back."""
    return explode_labels(label_documents(labelled_documents(spark, folder)[1], per_document=100))


@query(
    "balanced_weights",
    f"""WITH {_LABELS_SQL}, c AS (SELECT label, count(*) AS n FROM lab WHERE label <> 'odd' GROUP BY label)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c""",
)
def balanced_weights(spark, folder):
    labels = labelled_documents(spark, folder)[1].where(F.col("label") != "odd")
    return tidy(L.balanced_weights(labels))
