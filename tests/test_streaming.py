"""Streams over several micro-batches give what batch gives."""

from __future__ import annotations

import random
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T_

import fixtures as fx
from wiregrain.operators import decode as D
from wiregrain.operators import features as X
from wiregrain.operators import rules as R
from wiregrain.operators import timewindows as T
from wiregrain.operators.detect import FEATURES, packet_ml_features, score, train_classifier
from wiregrain.operators.windows import inter_arrival, rolling_features
from wiregrain.session import settle
from wiregrain.sources.captures import read_packets
from wiregrain.streaming import blocks, jobs, rolling
from wiregrain.streaming import sources as S
from wiregrain.streaming.gaps import gap_stream
from wiregrain.streaming.pairing import OpenRequests, pair_stream


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Three files of packets in order, read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("landed") / "p")
    rows = fx.packet_rows(90)
    for i in range(3):
        part = spark.createDataFrame(rows[i * 30 : i * 30 + 30], fx.PACKETS)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def decoded_stream(spark, path):
    return D.decode(S.packet_stream(spark, path, maxFilesPerTrigger=1), D.MODBUS)


def test_rolling_state_survives_batches(spark, landed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    got = jobs.run_available(rolling.rolling_stream(decoded_stream(spark, landed), ["capture_id", "unit_id"]))
    want = rolling_features(
        D.decode(spark.read.parquet(landed), D.MODBUS), ["timing", "size", "function_code"], keys=["capture_id", "unit_id"]
    )
    names = ["time_delta", "time_delta_mean_10", "time_delta_std_10", "time_delta_cv_10", "packet_length_mean_10", "function_code_stability_10"]
    cols = ["unit_id", "packet_number", "function_code_changes", *[F.round(c, 6).alias(c) for c in names]]
    a, b = got.select(cols), want.select(cols)
    assert a.count() == 90 and a.exceptAll(b).count() == 0


def test_windows_and_codes(spark, landed):
    out = jobs.run_available(T.window_metrics(decoded_stream(spark, landed), "2 seconds", "1 second", late="1 second"))
    want = T.window_metrics(D.decode(spark.read.parquet(landed), D.MODBUS), "2 seconds", "1 second")
    closed = want.where(F.col("window_end") <= out.agg(F.max("window_end")).scalar())
    assert out.count() > 3 and out.exceptAll(want).count() == 0 and closed.exceptAll(out).count() == 0
    codes = jobs.run_available(T.window_codes(decoded_stream(spark, landed), "1 second", None, "1 second"))
    assert codes.count() > 5


def test_sessions_keep_their_dominant_code(spark, tmp_path):
    """Sessions that grow and merge over four micro-batches; ties go to the smallest code."""
    times = [[(0, 6), (1, 3), (9, 3)], [(5, 6), (40, 16), (41, 5)], [(60, 1), (70, 2), (71, 2)], [(200, 3)]]
    schema = "k string, packet_number long, ts timestamp, function_code int"
    for i, batch in enumerate(times):
        rows = [("a", i * 10 + j, datetime.fromtimestamp(1_700_000_000 + t), c) for j, (t, c) in enumerate(batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    whole = spark.read.parquet(str(tmp_path / "p"))
    stream = S.packet_stream(spark, str(tmp_path / "p"), schema=whole.schema, maxFilesPerTrigger=1)
    got = jobs.run_available(T.session_codes(stream, ["k"], "6 seconds", late="1 minute"))
    want = T.session_codes(whole, ["k"], "6 seconds").where("session_start < timestamp_seconds(1700000130)")
    assert got.count() == want.count() >= 4 and got.exceptAll(want).count() == 0


def test_pairs_over_batches(spark, tmp_path):
    """Open requests and waiting responses live on in the state; late sides, ties and orphans as in batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    pick = random.Random(5)
    rows, now = [], 1_700_000_000.0
    for number in range(600):
        now += pick.choice([0, 0, 0.25, 1.5, 4])
        rows.append((pick.choice("abc"), number, now, pick.random() < 0.5))
    rows.append(("end", 600, now + 1000, True))
    schema = "k string, packet_number long, ts timestamp, is_request boolean"
    mixed = sorted(rows, key=lambda r: r[2] + pick.uniform(0, 3))  # sides arrive out of order
    for i in range(0, len(mixed), 151):
        part = [(k, n, datetime.fromtimestamp(t), q) for k, n, t, q in mixed[i : i + 151]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    whole = spark.read.parquet(str(tmp_path / "p"))
    stream = S.packet_stream(spark, str(tmp_path / "p"), schema=whole.schema, maxFilesPerTrigger=1)
    got = {r.request_number: tuple(r) for r in jobs.run_available(pair_stream(stream, ["k"], "5 seconds")).collect()}
    messages = [(k, n, round(t * 1e6), q) for k, n, t, q in rows if k != "end"]
    for k, n, us, q in messages:
        if q:
            replies = [(u, m) for x, m, u, asks in messages if x == k and not asks and us <= u <= us + 5_000_000]
            answer = min(replies, default=(None, None))
            delay = None if answer[0] is None else (answer[0] - us) / 1000
            assert got.pop(n) == (k, n, answer[1], delay)
    assert not got


def test_scores_of_a_stream_equal_batch(spark, landed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    batch = packet_ml_features(spark.read.parquet(landed))
    rule = F.when(F.col("mb_func_code") == 16, 1).otherwise(0)
    model = train_classifier(batch.withColumn("numeric_label", rule), ["mb_func_code", "inter_arrival_time"], numTrees=3)
    stream = jobs.ml_feature_stream(S.packet_stream(spark, landed, maxFilesPerTrigger=1))
    columns = ["mb_func_code", "inter_arrival_time"]
    got = jobs.run_available(jobs.score_stream(model, stream, columns))
    want = score(model, batch, columns)
    cols = ["packet_number", "prediction", F.round("confidence", 9).alias("c"), F.round("inter_arrival_time", 6).alias("gap"), *FEATURES[:6]]
    a, b = got.select(cols), want.select(cols)
    assert a.count() == b.count() == 90 and a.exceptAll(b).count() == 0


def test_rules_against_a_stored_baseline(spark, landed):
    batch = X.all_features(D.decode(spark.read.parquet(landed), D.MODBUS), D.MODBUS)
    baseline = settle(R.capture_baseline(batch))
    stored = str(landed) + "_features"
    batch.write.parquet(stored)
    stream = spark.readStream.schema(batch.schema).parquet(stored)
    got = jobs.run_available(jobs.flag_stream(stream, baseline))
    assert got.where("is_anomaly").count() == R.flag_anomalies(batch).where("is_anomaly").count()


def test_raw_packets_reach_the_rules(spark, landed):
    """Packets of three micro-batches, decoded, kept as state and flagged, equal the batch rules."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    batch = X.all_features(D.decode(spark.read.parquet(landed), D.MODBUS), D.MODBUS)
    baseline = settle(R.capture_baseline(batch))
    stream = jobs.feature_stream(S.packet_stream(spark, landed, maxFilesPerTrigger=1), D.MODBUS)
    got = jobs.run_available(jobs.flag_stream(stream, baseline))
    want = R.flag_anomalies(batch)
    names = ["time_delta_ms", "time_delta_max_10", "payload_entropy_mean_10", "payload_entropy_std_10", "periodicity_score"]
    cols = ["packet_number", "is_anomaly", "anomaly_reasons", "is_burst", "burst_streak", *[F.round(c, 6).alias(c) for c in names]]
    a, b = got.select(cols), want.select(cols)
    assert a.count() == b.count() == 90 and a.exceptAll(b).count() == 0
    assert R.anomaly_report(got).count() == R.anomaly_report(want).count()


def test_capture_files_as_a_stream(spark, tmp_path):
    frames = [(fx.packet_time(i), fx.ip_frame(fx.modbus_bytes(i), "1.1.1.1", "2.2.2.2", 5000, 502)) for i in range(12)]
    fx.write_pcap(str(tmp_path / "a.pcap"), frames[:7])
    fx.write_pcap(str(tmp_path / "b.pcap"), frames[7:])
    got = jobs.run_available(S.capture_stream(spark, str(tmp_path)))
    want = read_packets(spark, str(tmp_path))
    assert got.count() == 12 and got.exceptAll(want).count() == 0


def test_attack_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "x.log").write_text('a ATTACK: {"source_ip": "10.0.0.1", "modbus_fc_used": 6}\nplain\n')
    assert jobs.run_available(S.attack_stream(spark, str(tmp_path))).count() == 1


def test_alerts_of_a_retried_batch_are_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([(1, "P1"), (2, "N")], "n int, prediction string")
    write = jobs.alert_writer(str(tmp_path / "alerts"))
    write(df, 0)
    write(df, 0)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == [1]


class _Held:
    """State of one group in place of Spark's: a list, and the timers asked for."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def appendValue(self, row):
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []


def test_a_bucket_of_requests_has_one_timer():
    """A timer for each second of each key, and the whole state read for each, took most of the time."""
    held, pairs = _Held(), OpenRequests(1, 5_000_000)
    pairs.init(held)
    n = 1000
    rows = pd.DataFrame({"us": np.arange(n) * 1_000_000, "number": np.arange(n), "asks": np.arange(n) % 2 == 0})
    rows["k0"] = np.array(["a", "b", None], object)[np.arange(n) // 2 % 3]
    assert list(pairs.handleInputRows((0,), iter([rows]), None)) == [] and len(held.timers) == 1
    out = list(pairs.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 600_000), None))
    assert [len(o) for o in out] == [298] and (out[0]["response_number"] == out[0]["request_number"] + 1).all()
    assert len(held.timers) == 2 and held.timers[1] == 601_000 and len(held.rows) == 1


def test_look_back_over_many_blocks(spark, tmp_path, monkeypatch):
    """A key's share of a micro-batch is cut into blocks; short ones, empty ones and null values give what batch gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    number = F.when(F.col("id") % 50 < 47, F.col("id")).otherwise(F.col("id") + 5000)
    rows = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, "a").alias("k"), number.alias("packet_number"), F.timestamp_micros(F.col("id") * F.col("id") * 1000).alias("ts"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("packet_length"), (F.col("id") % 3).cast("int").alias("function_code"),
    )
    for low in range(0, 300, 100):
        rows.where(F.col("packet_number").between(low, low + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    rows.where("packet_number >= 5000").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = S.packet_stream(spark, str(tmp_path / "p"), schema=rows.schema, maxFilesPerTrigger=1)
    got = jobs.run_available(rolling.rolling_stream(stream, ["k"]))
    want = rolling_features(rows, ["timing", "size", "function_code"], keys=["k"])
    names = ["time_delta", "time_delta_mean_10", "time_delta_std_10", "time_delta_max_10", "function_code_stability_10"]
    cols = ["k", "packet_number", "ts", "function_code_changes", "burst_streak", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in names]]
    a, b = got.select(cols), want.select(cols)
    assert a.count() == b.count() == 300 and a.exceptAll(b).count() == 0
    gaps = jobs.run_available(gap_stream(stream, ["k"])).select("k", "packet_number", F.round("inter_arrival_time", 6).alias("gap"))
    kept = inter_arrival(rows, keys=["k"]).select("k", "packet_number", F.round("inter_arrival_time", 6).alias("gap"))
    assert gaps.count() == 300 and gaps.exceptAll(kept).count() == 0


def test_a_block_is_all_that_python_holds(spark, tmp_path):
    """The functions of a stream get blocks, not a key's whole share of a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    count = 3 * blocks.BLOCK
    rows = spark.range(count).select(F.lit("a").alias("k"), F.col("id").alias("packet_number"), F.timestamp_micros("id").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = S.packet_stream(spark, str(tmp_path / "p"), schema=rows.schema)
    largest = lambda rows: pd.DataFrame({"held": np.full(len(rows), len(rows))})
    out = T_.StructType([*rows.schema.fields, T_.StructField("held", T_.LongType())])
    got = jobs.run_available(blocks.look_back(stream.withColumn("us", F.unix_micros("ts").cast("double")), ["k"], "packet_number", {"us": "double"}, 1, largest, out))
    assert got.count() == count and got.agg(F.max("held")).first()[0] <= blocks.BLOCK


def test_windows_copy_step_sums_and_not_packets(spark, tmp_path, monkeypatch):
    """A row for each side of each packet in each window was too much; nulls, ties and small tasks give the same windows."""
    monkeypatch.setattr(T, "STEP_ROWS", 7)
    rows = spark.range(400).select(
        F.timestamp_micros(F.col("id") * 700_000).alias("ts"), (F.col("id") % 90).alias("packet_length"), (F.col("id") % 3 > 0).alias("is_valid"),
        *[F.when(F.col("id") % n > 0, F.col("id") % n).cast("string").alias(c) for c, n in (("src_ip", 11), ("dst_ip", 5))],
        (F.col("id") % 4).alias("unit_id"), (F.col("id") % 7).cast("int").alias("function_code"),
    )
    for part in range(4):
        rows.where(F.floor(F.unix_micros("ts") / 70_000_000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = S.packet_stream(spark, str(tmp_path / "p"), schema=rows.schema, maxFilesPerTrigger=1)
    windows = T.window_metrics(stream, "60 seconds", "10 seconds", late="5 seconds")
    assert "Generate" not in windows._jdf.queryExecution().analyzed().toString()
    got, want = jobs.run_available(windows), T.window_metrics(rows, "60 seconds", "10 seconds")
    closed = want.where(F.col("window_end") <= got.agg(F.max("window_end")).first()[0])
    assert got.count() == closed.count() > 20 and got.exceptAll(want).count() == 0
    tasks = T.window_metrics(rows, "60 seconds", "10 seconds")._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in tasks
