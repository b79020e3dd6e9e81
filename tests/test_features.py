"""Golden values and invariants of the packet features on the synthetic captures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import modbus_bytes, packets
from wiregrain.functions.entropy import classify_entropy, is_entropy_normal, register, shannon_entropy
from wiregrain.operators import decode as D
from wiregrain.operators import features as X
from wiregrain.operators import rules as R
from wiregrain.operators import stats as S


@pytest.fixture(scope="module")
def modbus(spark):
    return X.all_features(D.decode(packets(spark, 20), D.MODBUS), D.MODBUS).orderBy("packet_number").cache()


@pytest.fixture(scope="module")
def dnp3(spark):
    return X.all_features(D.decode(packets(spark, 20, "dnp3"), D.DNP3), D.DNP3).orderBy("packet_number").cache()


def test_modbus_header_and_entropy(modbus):
    rows = modbus.collect()
    assert len(rows) == 20
    first = rows[0]
    assert (first.transaction_id, first.unit_id, first.function_code) == (0, 1, 1)
    for r in rows:
        assert (r.packet_length, r.modbus_length, r.data_length) == (12, 6, 4)
        assert r.length_consistent == 1 and r.is_valid
        assert r.payload_entropy == pytest.approx(0.811278, abs=1e-6)
        assert r.entropy_classification == "Very Low (Highly repetitive)"
        assert not r.is_normal_entropy
    assert first.header_entropy == pytest.approx(1.148835, abs=1e-6)
    assert first.full_packet_entropy == pytest.approx(1.418296, abs=1e-6)
    heads = [r.header_entropy for r in rows]
    full = [r.full_packet_entropy for r in rows]
    assert max(heads) == pytest.approx(1.664498, abs=1e-6)
    assert sum(heads) / 20 == pytest.approx(1.624429, abs=1e-6)
    assert max(full) == pytest.approx(1.947339, abs=1e-6)
    assert sum(full) / 20 == pytest.approx(1.887553, abs=1e-6)


def test_modbus_windows(modbus):
    rows = modbus.collect()
    assert rows[0].time_delta is None
    assert [round(r.time_delta, 6) for r in rows[1:4]] == [0.12, 0.12, 0.06]
    last = rows[-1]
    assert last.time_delta_mean_10 == pytest.approx(0.102, abs=1e-7)
    assert last.time_delta_std_10 == pytest.approx(0.0289827, abs=1e-6)
    assert last.time_delta_cv_10 == pytest.approx(0.284144, abs=1e-5)
    assert all(r.function_code_changes == 1 and r.function_code_stability_10 == 0.0 for r in rows)
    assert rows[0].burst_indicator == 0 and rows[0].time_delta_cv_10 == 0.0
    for r in rows[1:]:
        assert r.time_delta_min_10 <= r.time_delta_mean_10 <= r.time_delta_max_10
        assert 0 <= r.periodicity_score <= 1
    assert last.traffic_intensity == pytest.approx(20 / 1.92, abs=1e-6)
    assert last.read_write_ratio == 3.0
    assert (last.unique_src_ips, last.unique_dst_ips, last.unique_unit_ids) == (1, 3, 5)
    assert {r.packets_per_dst for r in rows} == {6, 7} and {r.packets_per_unit for r in rows} == {4}
    assert last.entropy_stability == 1.0


def test_summary(modbus):
    s = S.summary_report(modbus).first()
    assert s.total_packets == 20 and s.unique_function_codes == 4
    assert s.iat_mean_ms == pytest.approx(101.0526, abs=1e-4)
    assert s.iat_std_ms == pytest.approx(28.6540, abs=1e-3)
    assert (round(s.iat_min_ms), round(s.iat_max_ms), round(s.iat_median_ms)) == (60, 120, 120)
    assert s.iat_cv == pytest.approx(0.283555, abs=1e-5)
    assert (s.read_count, s.write_count, s.error_count) == (15, 5, 0)
    assert s.validity_rate == 100.0
    assert s.function_code_distribution == {1: 5, 3: 5, 4: 5, 16: 5}
    assert s.unit_id_distribution == {i: 4 for i in range(1, 6)}


def test_rules(modbus):
    flagged = R.flag_anomalies(modbus).collect()
    assert all(r.is_anomaly and r.statistical_anomaly and r.pattern_anomaly for r in flagged)
    assert not any(r.protocol_violation for r in flagged)
    reasons = {tuple(r.anomaly_reasons) for r in R.detect_anomalies(modbus).collect()}
    assert reasons == {
        (
            "Pattern Anomaly: Rapid Function Code Change",
            "Statistical Outlier (Packet Size, IAT, or Entropy)",
        )
    }


def test_burst_and_scan_reasons(spark):
    """Two hundred packets in 20 ms with eleven codes: both a burst and a scan."""
    base = packets(spark, 200)
    quick = base.withColumn("ts", F.timestamp_micros(1_234_567_890_000_000 + F.col("packet_number") * 100))
    code = F.unhex(F.lpad(F.hex(F.col("packet_number") % 11 + 1), 2, "0"))
    quick = quick.withColumn(
        "payload",
        F.concat(F.substring("payload", 1, 7), code, F.substring("payload", 9, 4)),
    )
    features = X.all_features(D.decode(quick, D.MODBUS), D.MODBUS, hot_rows=50)
    report = R.detect_anomalies(features).collect()
    assert len(report) == 200
    texts = [" ".join(r.anomaly_reasons) for r in report]
    assert all("Function Code Scanning" in t for t in texts)
    assert sum("Burst Traffic" in t for t in texts) >= 190
    assert sum("Protocol Violation" in t for t in texts) == sum(7 <= r.function_code <= 11 for r in report)


def test_dnp3(dnp3):
    rows = dnp3.collect()
    assert len(rows) == 20
    assert all(r.packet_length == 15 and r.data_length == 4 and r.modbus_length == 10 for r in rows)
    assert all(r.length_consistent == 0 for r in rows)
    assert sum(r.is_read_operation for r in rows) == 5
    assert sum(r.is_write_operation for r in rows) == 5
    assert sum(r.is_error_response for r in rows) == 5
    assert rows[0].read_write_ratio == 1.0
    assert rows[0].payload_entropy == pytest.approx(0.811278, abs=1e-6)
    assert rows[0].header_entropy == pytest.approx(2.521641, abs=1e-6)
    assert rows[0].full_packet_entropy == pytest.approx(1.871602, abs=1e-6)
    assert (rows[1].unit_id, rows[1].transaction_id, rows[1].function_name) == (2, 1, "READ")


def test_steady_traffic_is_regular(spark):
    rows = X.all_features(
        D.decode(packets(spark, 50, code=3, jitter=False), D.MODBUS), D.MODBUS
    ).collect()
    assert max(r.time_delta_cv_10 for r in rows) < 0.5
    assert sum(r.function_code_changes for r in rows) == 1


def test_empty_input(spark):
    empty = D.decode(packets(spark, 1).where("false"), D.MODBUS)
    basic = D.basic_features(empty)
    assert basic.count() == 0 and set(D.BASIC_COLUMNS) <= set(basic.columns)
    s = S.summary_statistics(X.all_features(empty, D.MODBUS), ()).first()
    assert s.total_packets == 0 and s.length_mean == 0.0 and s.iat_median_ms == 0.0 and s.valid_packets == 0
    e = S.entropy_statistics(X.all_features(empty, D.MODBUS)).first()
    assert (e["mean"], e["std"], e["median"]) == (0.0, 0.0, 0.0)
    assert R.detect_anomalies(X.all_features(empty, D.MODBUS)).count() == 0


def test_entropy_units(spark):
    values = [bytes([1]) * 100, bytes(range(256)), bytes(range(6)) * 10, b"", None]
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, b binary")
    got = [r.e for r in df.select("i", shannon_entropy(F.col("b")).alias("e")).orderBy("i").collect()]
    assert got == pytest.approx([0.0, 8.0, 2.584963, 0.0, 0.0], abs=1e-6)
    register(spark)
    df.createOrReplaceTempView("payloads")
    assert spark.sql("SELECT max(shannon_entropy(b)) AS m FROM payloads").first().m == pytest.approx(8.0)


def test_entropy_of_a_long_value(spark):
    """Whole values are counted, however long."""
    long = b"\x00" * (40 << 20) + b"\x01" * (40 << 20)
    df = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(long),)], "b binary")
    assert [r.e for r in df.select(shannon_entropy(F.col("b")).alias("e")).collect()] == [1.0, 1.0]


def test_entropy_classes(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0, 4.0, 6.0, 7.0, 3.5, 6.5)], "e double")
    rows = df.select("e", classify_entropy(F.col("e")).alias("c"), is_entropy_normal(F.col("e")).alias("n")).collect()
    assert [r.c.split(" (")[0] for r in rows[:5]] == ["Very Low", "Low", "Medium", "High", "Very High"]
    assert [r.n for r in rows] == [False, False, True, True, False, True, True]


def test_short_and_wrong_payloads(spark):
    base = packets(spark, 6)
    bodies = [b"\x00" * 6, b"\x00\x01\x00\x00\x00\x02\x01", modbus_bytes(1, 131), b"\x00\x01\x00\x05" + modbus_bytes(1)[4:], modbus_bytes(1, 0), b""]
    fix = F
    for i, b in enumerate(bodies, 1):
        fix = fix.when(F.col("packet_number") == i, F.lit(b))
    odd = base.withColumn("payload", fix)
    rows = {r.packet_number: r for r in D.decode(odd, D.MODBUS, keep_invalid=True).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].transaction_id is None and rows[1].function_name == "Unknown" and not rows[1].is_valid
    assert rows[2].unit_id == 1 and rows[2].function_code is None and rows[2].data_length == 0
    assert rows[3].function_name == "Error Response (Exception Code: 3)"
    assert rows[4].protocol_id == 5 and not rows[4].is_valid
    assert rows[5].function_name == "Unknown"
    assert D.decode(odd, D.MODBUS).count() == 0
    audit = D.capture_audit(odd, D.MODBUS).first()
    assert (audit.frames, audit.protocol_packets, audit.valid_packets) == (6, 5, 0)


def test_function_names(spark):
    df = spark.createDataFrame([(0,), (1,), (23,), (99,), (131,), (None,)], "c int")
    names = df.select(
        D.function_name(F.col("c"), D.MODBUS).alias("m"), D.function_name(F.col("c"), D.DNP3).alias("d")
    ).collect()
    assert [r.m for r in names] == [
        "Unknown",
        "Read Coils",
        "Read/Write Multiple Registers",
        "Unknown Function Code: 99",
        "Error Response (Exception Code: 3)",
        "Unknown",
    ]
    assert [r.d for r in names] == [
        "CONFIRM",
        "READ",
        "Unknown Function Code: 23",
        "Unknown Function Code: 99",
        "Response (Code: 131)",
        "Unknown",
    ]


def test_feature_matrix_has_no_missing_values(modbus):
    matrix = X.feature_matrix(modbus)
    row = matrix.first()
    assert len(row.features) == len(matrix.columns) - 3
    assert matrix.where(" OR ".join(f"isnull({c}) OR isnan({c})" for c in matrix.columns[2:-1])).count() == 0
    assert {"is_valid", "fc_3"} <= set(matrix.columns)


def test_extraction_is_repeatable(spark):
    packets_ = packets(spark, 30)
    once, twice = (X.all_features(D.decode(packets_, D.MODBUS), D.MODBUS) for _ in range(2))
    assert once.exceptAll(twice).count() == 0
