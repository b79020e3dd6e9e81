"""Capture files, label files, logs and exports."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from wiregrain.operators import decode as D
from wiregrain.operators.distributions import class_by_protocol
from wiregrain.operators.features import one_hot
from wiregrain.operators.fingerprint import frequency_distributions, group_stats, stats_long
from wiregrain.operators.rules import malformed_connections
from wiregrain.plans import analysis
from wiregrain.sources import captures as cap
from wiregrain.sources import logs, sinks
from wiregrain.sources.labels import explode_labels, read_labels

A, B = "192.168.1.100", "192.168.1.10"


def modbus_frames(n: int, **kw) -> list[tuple[float, bytes]]:
    return [
        (fx.packet_time(i), fx.ip_frame(fx.modbus_bytes(i), A, B, 50000, 502, **kw)) for i in range(n)
    ]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("captures")
    (base / "modbus").mkdir()
    (base / "dnp3").mkdir()
    mixed = modbus_frames(40)
    mixed.insert(3, (fx.packet_time(3), fx.arp_frame()))
    mixed.insert(7, (fx.packet_time(7), fx.ip_frame(b"query", A, B, 1234, 53, udp=True)))
    mixed.insert(9, (fx.packet_time(9), fx.ip_frame(b"", A, B, 50000, 502)))
    fx.write_pcap(str(base / "modbus" / "a.pcap"), mixed)
    fx.write_pcap(str(base / "modbus" / "big_endian.pcap"), modbus_frames(5, vlan=True), ">", nano=True)
    dnp3 = [(fx.packet_time(i), fx.ip_frame(fx.dnp3_bytes(i), A, B, 50000, 20000)) for i in range(20)]
    fx.write_pcapng(str(base / "dnp3" / "d.pcapng"), dnp3)
    (base / "modbus" / "broken.pcap").write_bytes(b"this is not a capture")
    cut = str(base / "modbus" / "cut.pcap")
    fx.write_pcap(cut, modbus_frames(4))
    with open(cut, "r+b") as f:
        f.truncate(os.path.getsize(cut) - 10)
    labels = [{"packet_number": i + 1, "label": ["N", "P1", "P2", "P3"][i % 4]} for i in range(43)]
    named = {"a.pcap": {"packet_labels": labels}}
    (base / "modbus" / "pcap_labels_1.json").write_text(json.dumps(named, indent=2))
    bare = {"packet_labels": [{"packet_number": i + 1, "label": "N"} for i in range(15)]}
    (base / "dnp3" / "x_labels.json").write_text(json.dumps(bare))
    several = {
        "big_endian.pcap": {"packet_labels": [{"packet_number": 1, "label": "P3"}]},
        "gone.pcap": {"packet_labels": [{"packet_number": 1, "label": "P3"}]},
    }
    (base / "modbus" / "other_labels.json").write_text(json.dumps(several))
    return str(base)


def test_all_frames_of_all_captures(spark, root):
    rows = cap.read_packets(spark, root).collect()
    count = {}
    for r in rows:
        count[r.capture_id] = count.get(r.capture_id, 0) + 1
    assert count == {"modbus/a.pcap": 43, "modbus/big_endian.pcap": 5, "dnp3/d.pcapng": 20, "modbus/cut.pcap": 3}
    a = sorted((r for r in rows if r.capture_id == "modbus/a.pcap"), key=lambda r: r.packet_number)
    assert [r.packet_number for r in a] == list(range(1, 44))
    assert (a[0].src_ip, a[0].dst_ip, a[0].src_port, a[0].dst_port) == (A, B, 50000, 502)
    assert bytes(a[0].payload) == fx.modbus_bytes(0)  # link padding is not data
    assert a[0].ts_epoch == pytest.approx(fx.START) and a[0].ip_len == 52 and a[0].frame_len == 66
    assert (a[3].is_tcp, a[3].is_udp, a[3].ip_len, a[3].src_ip, a[3].payload) == (0, 0, 0, None, None)
    assert (a[7].is_udp, a[7].dst_port, bytes(a[7].payload)) == (1, 53, b"query")
    big = [r for r in rows if r.capture_id == "modbus/big_endian.pcap"]
    assert all(r.dst_port == 502 for r in big)
    assert {round(r.ts_epoch - fx.START, 6) for r in big} == {0.0, 0.12, 0.24, 0.3, 0.42}
    d = [r for r in rows if r.capture_id == "dnp3/d.pcapng"]
    assert {r.protocol for r in d} == {"dnp3"}
    assert max(r.ts_epoch for r in d) == pytest.approx(fx.packet_time(19), abs=1e-6)


def test_small_parts_give_the_same_packets(spark, root):
    files = cap.list_captures(spark, root)
    parts = cap.capture_parts(files, part_bytes=200).cache()
    assert parts.where("capture_id = 'modbus/a.pcap'").count() > 10
    whole = cap.read_packets(spark, root)
    split = cap.read_packets(spark, root, parts=parts)
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0


def test_bad_files_are_reported(spark, root):
    bad = {r.capture_id: r.problem for r in cap.bad_files(cap.read_parts(spark, root)).collect()}
    assert set(bad) == {"modbus/broken.pcap", "modbus/cut.pcap"}
    assert "not a capture" in bad["modbus/broken.pcap"] and bad["modbus/cut.pcap"] == "truncated"


def test_protocol_packets(spark, root):
    packets = cap.read_packets(spark, root)
    assert D.decode(packets, D.MODBUS).where("capture_id = 'modbus/a.pcap'").count() == 40
    assert D.decode(packets, D.DNP3).count() == 20
    tags = {(r.source_pcap, r.source_dir) for r in cap.list_captures(spark, root).collect()}
    assert ("a.pcap", "modbus") in tags and ("d.pcapng", "dnp3") in tags


def test_label_files(spark, root):
    files = cap.list_captures(spark, root)
    rows = read_labels(spark, root, files).collect()
    by = {}
    for r in rows:
        by.setdefault(r.capture_id, {})[r.packet_number] = r.label
    assert set(by) == {"modbus/a.pcap", "dnp3/d.pcapng", "modbus/big_endian.pcap", "modbus/gone.pcap"}
    assert len(by["modbus/a.pcap"]) == 43 and by["modbus/a.pcap"][2] == "P1"
    assert len(by["dnp3/d.pcapng"]) == 15
    bare = spark.createDataFrame([('{"packet_labels": [{"packet_number": 7, "label": "P2"}]}',)], "value string")
    assert [tuple(r) for r in explode_labels(bare).collect()] == [(None, 7, "P2")]


def test_train_and_score_directory(spark, root, tmp_path):
    data = analysis.training_set(spark, root)
    assert data.count() == 43 + 15 + 1
    assert {r.protocol for r in class_by_protocol(data).collect()} == {"modbus", "dnp3"}
    model, scored = analysis.train(data, numTrees=5, maxDepth=4)
    assert {"prob_N", "prob_P3", "confidence", "prediction"} <= set(scored.columns)
    sinks.save_model(model, str(tmp_path / "model"))
    loaded = logs.load_model(str(tmp_path / "model"))
    packets, verdicts, bad = analysis.score_directory(spark, root, loaded)
    assert packets.count() == 71 and bad.count() == 2
    total = packets.agg(F.max(F.abs(F.col("prob_N") + F.col("prob_P1") + F.col("prob_P2") + F.col("prob_P3") - 1)))
    assert total.first()[0] < 1e-9
    v = {r.capture_id: r for r in verdicts.collect()}
    assert v["dnp3/d.pcapng"].packets == 20 and v["modbus/a.pcap"].modbus_packets == 40
    sinks.save_predictions(packets, str(tmp_path / "predictions"))
    assert spark.read.option("header", True).csv(str(tmp_path / "predictions")).count() == 71


def test_analyse_directory(spark, root, tmp_path):
    out = str(tmp_path / "out")
    result = analysis.analyse_directory(spark, root, "modbus", out)
    assert result.features.count() == 40 + 5 + 3
    assert {r.capture_id: r.valid_packets for r in result.audit.collect()}["dnp3/d.pcapng"] == 0
    for name in ("features", "statistics", "summary", "fingerprint_summary", "freq_distributions", "anomalies"):
        assert os.path.isdir(f"{out}/{name}"), name
    assert spark.read.option("header", True).csv(f"{out}/features").count() == 48


def test_save_features(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], bytearray(b"\x01"))], "a int, b array<int>, c binary")
    for fmt in sinks.FORMATS:
        sinks.save_features(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "[1,2]"
    assert spark.read.parquet(str(tmp_path / "parquet")).first().b == [1, 2]
    with pytest.raises(ValueError):
        sinks.save_features(df, str(tmp_path / "x"), "xml")
    assert sinks.save_anomalies(df.where("a > 1"), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()


def test_saved_labels_can_be_read_back(spark, tmp_path):
    rows = [("c1", i, "N" if i % 3 else "P1") for i in range(1, 31)]
    labels = spark.createDataFrame(rows, "capture_id string, packet_number long, label string")
    docs = sinks.label_documents(labels, per_document=7)
    assert docs.count() == 5
    sinks.save_labels(labels, str(tmp_path / "labels"))
    back = explode_labels(spark.read.text(str(tmp_path / "labels")))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_saved_fingerprint_can_be_read_back(spark, tmp_path):
    rows = [("a", "b", i % 2, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, unit_id int, x double")
    long = stats_long(group_stats(df, features=["x"], with_thresholds=True))
    assert {(r.threshold, r.count_below + r.count_above) for r in long.collect()} == {(4.5, 5)}
    sinks.save_features(long, str(tmp_path / "fp"), "json")
    back = logs.read_fingerprint(spark, str(tmp_path / "fp"))
    assert back.exceptAll(long).count() == 0 and back.count() == 2
    with pytest.raises(ValueError):
        group_stats(df, ["nope"])
    assert frequency_distributions(df, features=["x"]).where("kind = 'value_counts'").count() == 10


def test_summary_documents_can_be_read_back(spark, tmp_path):
    rows = [("a", i, i % 3, 1.0 * i) for i in range(9)]
    report = spark.createDataFrame(rows, "capture_id string, total_packets int, unit_id int, mean double")
    sinks.save_summary(report, str(tmp_path / "summary"))
    back = logs.read_summary(spark, str(tmp_path / "summary"))
    assert back.count() == 9 and back.agg({"mean": "max"}).first()[0] == 8.0


def test_parts_are_read_by_as_many_tasks(spark, root):
    """Parts are a few bytes; without a given count they would all land in one task."""
    parts = cap.capture_parts(cap.list_captures(spark, root), part_bytes=1).cache()
    frames = cap.read_frames(parts)
    n = parts.where("packets > 0").count()
    tasks = frames.select(F.spark_partition_id().alias("p")).distinct().count()
    assert n > 10 and tasks > 0.8 * n  # dealt round robin from several lists of parts
    whole = cap.read_frames(cap.capture_parts(cap.list_captures(spark, root)))
    assert frames.exceptAll(whole).count() == 0 and frames.count() == whole.count()


def test_one_hot_needs_codes_beyond_a_byte(spark):
    df = spark.range(300)
    with pytest.raises(ValueError):
        one_hot(df, column="id", prefix="i")
    assert len(one_hot(df, range(300), "id", "i").columns) == 301


def test_damaged_and_empty_captures_keep_what_is_good(spark, tmp_path):
    import struct

    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    record = struct.pack("<IIII", 1, 0, 20, 20) + bytes(20)
    (tmp_path / "empty.pcap").write_bytes(head)
    (tmp_path / "bad.pcap").write_bytes(head + record * 3 + struct.pack("<IIII", 1, 0, 1 << 31, 1 << 31) + bytes(9))
    parts = {r.capture_id: r for r in cap.capture_parts(cap.list_captures(spark, str(tmp_path))).collect()}
    assert parts["empty.pcap"].packets == 0 and parts["empty.pcap"].problem is None
    assert parts["bad.pcap"].packets == 3 and parts["bad.pcap"].problem == "truncated"


def test_attack_log(spark, tmp_path):
    event = {"timestamp_utc": "2024-01-01T00:00:01.500000+00:00", "source_ip": "10.0.0.12", "modbus_fc_used": 6, "injected_value": 99}
    lines = ["2024 INFO start", "2024 INFO ATTACK: " + json.dumps(event), "2024 INFO ATTACK: {broken"]
    (tmp_path / "a.log").write_text("\n".join(lines))
    rows = logs.read_attack_log(spark, str(tmp_path / "a.log")).collect()
    assert len(rows) == 1 and rows[0].modbus_fc_used == 6
    assert rows[0].ts.timestamp() == pytest.approx(1704067201.5)


def test_process_model(spark, tmp_path):
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"safe_ranges": {"40001": [1, 2]}, "plc_targets": [{"logical_ip": "1.2.3.4", "unit_id": 9}]}, indent=1))
    assert [tuple(r) for r in logs.read_safe_ranges(spark, str(path)).collect()] == [(40001, 1, 2)]
    assert [tuple(r) for r in logs.read_plc_targets(spark, str(path)).collect()] == [("1.2.3.4", 9)]
    assert logs.read_safe_ranges(spark, str(tmp_path / "missing.json")).count() == 4


def test_zeek_logs(spark, tmp_path):
    weird = (
        "#separator \\x09\n#fields\tts\tuid\n"
        "1.5\tC1\t10.0.0.1\t5000\t10.0.0.2\t20000\tunknown_fc\t-\tF\tzeek\n"
        "2.5\tC1\t10.0.0.1\t5000\t10.0.0.2\t20000\tunknown_fc\t\"x\tT\tzeek\n"
    )
    conn = "#fields\n1.0\tC1\t10.0.0.1\t5000\t10.0.0.2\t20000\ttcp\tdnp3\t0.25\t10\t20\tSF\t-\t-\t0\tShAD\t3\t90\t2\t80\t(empty)\n"
    (tmp_path / "weird.log").write_text(weird)
    (tmp_path / "conn.log").write_text(conn)
    w = logs.read_zeek(spark, str(tmp_path / "weird.log"), "weird")
    c = logs.read_zeek(spark, str(tmp_path / "conn.log"), "conn")
    rows = w.orderBy("ts").collect()
    assert (rows[0].id_resp_p, rows[0].addl, rows[0].notice, rows[1].addl, rows[1].notice) == (20000, None, False, '"x', True)
    r = c.first()
    assert (r.duration, r.orig_bytes, r.tunnel_parents, r.local_orig) == (0.25, 10, [], None)
    assert rows[0].ts_time.timestamp() == 1.5
    assert [tuple(r) for r in malformed_connections(w, c).collect()] == [("unknown_fc", "10.0.0.1", "10.0.0.2", 2, 1)]
