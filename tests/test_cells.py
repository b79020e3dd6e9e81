"""Pairing, matching and curves whose rows crowd into one cell: same results, bounded slices."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

import fixtures as fx
from wiregrain.operators import attacks as A
from wiregrain.operators import decode as D
from wiregrain.operators import flows as L
from wiregrain.operators import metrics as M
from wiregrain.operators.spread import SLICE, find_hot, with_slice
from wiregrain.sources import captures as cap
from wiregrain.sources.frames import FrameReader, capture_frames, read_protocol


def test_a_flooded_cell_is_paired_in_slices(spark):
    pick = random.Random(3)
    us = [1_700_000_000_000_000 + pick.randrange(4_000_000 if pick.random() < 0.2 else 3000) for _ in range(1500)]
    rows = [("flood" if pick.random() < 0.9 else None, i, u, pick.random() < 0.7) for i, u in enumerate(sorted(us))]
    df = spark.createDataFrame(rows, "k string, packet_number long, us long, is_request boolean")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    where = {"keys": ["k"], "timeout_seconds": 0.5}
    got, want = L.pair_requests(df, hot_rows=40, **where), L.pair_requests(df, hot_rows=None, **where)
    assert got.count() == want.count() > 900 and got.exceptAll(want).count() == 0
    replies = [(k, u, n) for k, n, u, q in rows if not q]
    some = {r.request_number: r.response_number for r in got.collect()}
    for k, n, u, q in rows[::7]:
        if q:
            after = [(v, m) for x, v, m in replies if x == k and (v, m) > (u, n) and v - u <= 500_000]
            assert some[n] == min(after, default=(None, None))[1]
    cut = with_slice(df, find_hot(df, ["k"], "us", 40))
    assert cut.groupBy("k", SLICE).count().agg(F.max("count")).first()[0] <= 60


def test_scores_close_to_one_are_many_slices(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "N").otherwise("P1").alias("label"),
        F.when(F.col("id") < 50, F.col("id") / 100).otherwise(1 - F.col("id") * 5e-11).alias("prob_N"),
    ).withColumn("prob_P1", 1 - F.col("prob_N"))
    got, want = M.roc_points(df, labels=["N", "P1"], hot_rows=500), M.roc_points(df, labels=["N", "P1"], hot_rows=1 << 40)
    assert got.count() == want.count() > 30_000 and got.exceptAll(want).count() == 0
    last = got.groupBy("class").agg(F.max("tp").alias("tp"), F.max("all_pos").alias("all")).collect()
    assert all(r.tp == r["all"] for r in last)
    steps = got.select("class", F.col("threshold").alias("score"))
    sizes = M.score_slices(steps, 500).groupBy("class", SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 500 and sizes.count() > 60


def test_detections_of_a_flood_in_one_second(spark):
    pick = random.Random(9)
    start = 1_700_000_000
    seen = [("c", i, datetime.fromtimestamp(start + pick.random()), pick.choice(["P1", "P2", "N"])) for i in range(2000)]
    packets = spark.createDataFrame(seen, "capture_id string, packet_number long, ts timestamp, prediction string")
    asked = [("c", i, datetime.fromtimestamp(start + pick.uniform(-0.1, 1.2)), "P1_APT") for i in range(40)]
    events = spark.createDataFrame(asked, "capture_id string, event_id long, ts timestamp, attacker_profile_id string")
    got = {r.event_id: r.detected_packets for r in A.match_detections(packets, events, 0.1, hot_rows=50).collect()}
    for _, n, at, _ in asked:
        assert got[n] == sum(p == "P1" and abs((t - at).total_seconds()) <= 0.1 for _, _, t, p in seen)


def test_filters_reach_the_frame_reader(spark, tmp_path, capsys):
    a, b = "10.0.0.1", "10.0.0.2"
    make = lambda i, port, **kw: (fx.packet_time(i), fx.ip_frame(fx.modbus_bytes(i), a, b, 50000 + i % 3, port, **kw))
    mixed = [make(i, 502) if i % 5 == 0 else make(i, 8080, udp=i % 2 == 0) for i in range(200)]
    fx.write_pcap(str(tmp_path / "a.pcap"), [*mixed, (fx.packet_time(200), fx.arp_frame())])
    fx.write_pcapng(str(tmp_path / "b.pcapng"), [make(i, 502, vlan=True) for i in range(30)])
    root = str(tmp_path)
    parts = cap.capture_parts(cap.list_captures(spark, root), part_bytes=2000).cache()
    whole = cap.read_packets(spark, root, parts=parts)
    frames = capture_frames(spark, root, parts=parts)
    same = ["capture_id", "packet_number", "src_port", "dst_port", "is_tcp", "is_udp", "protocol"]
    assert frames.count() == 231 and frames.select(same).exceptAll(whole.select(same)).count() == 0
    got, want = read_protocol(spark, root, D.MODBUS, parts=parts), whole.where("protocol = 'modbus'")
    assert got.count() == want.count() == 70 and got.exceptAll(want).count() == 0
    some = frames.where("dst_port = 8080 and packet_number > 50 and capture_id in ('a.pcap', 'x') and src_port <> 50001")
    expected = whole.where("dst_port = 8080 and packet_number > 50 and capture_id = 'a.pcap' and src_port <> 50001")
    assert some.count() == expected.count() > 50
    frames.where("protocol = 'modbus'").explain("formatted")
    assert "EqualTo(protocol,modbus)" in capsys.readouterr().out.replace(" ", "")
    # What leaves the reader: 70 of 231 frames.
    from pyspark.sql.datasource import EqualTo

    folder = str(tmp_path / "parts")
    parts.where("packets > 0").write.parquet(folder)
    reader = FrameReader(folder)
    assert list(reader.pushFilters([EqualTo(("protocol",), "modbus")])) == []
    assert sum(batch.num_rows for p in reader.partitions() for batch in reader.read(p)) == 70
