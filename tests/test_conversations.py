"""Transaction id steps and the criteria on conversations and halves, against plain Python and known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiregrain.operators import baseline as B
from wiregrain.operators import flows as L

KEYS = ["capture_id", "client_ip", "client_port", "server_ip"]


def brute(ids):
    out = []
    for i, t in enumerate(ids):
        step = (t - ids[i - 1]) % 65536 if i else None
        before = (ids[i - 1] - ids[i - 2]) % 65536 if i > 1 else None
        regular = None if step is None else step == 1 or step == before
        out.append((step, regular, None if step is None else 0 if regular else max(step - 1, 0)))
    return out


@pytest.mark.parametrize("hot_rows", [None, 7])
def test_steps_equal_plain_python(spark, hot_rows):
    rng = np.random.default_rng(2)
    series = {
        ("a", "c1"): [(65530 + i) % 65536 for i in range(60)],  # sequential, wraps
        ("a", None): [(3 * i) % 65536 for i in range(40)],  # another stride
        ("b", "c1"): [i % 4 for i in range(50)],  # cyclic
        (None, "c2"): rng.integers(0, 65536, 70).tolist(),
        ("b", "c3"): [9],
    }
    rows = [(cap, ip, 1, "s", i, True, t) for (cap, ip), ids in series.items() for i, t in enumerate(ids)]
    rows += [("a", "c1", 1, "s", 1000 + i, False, 5) for i in range(20)]  # responses do not count
    names = "capture_id string, client_ip string, client_port int, server_ip string, packet_number long, is_request boolean, transaction_id int"
    steps = L.transaction_steps(spark.createDataFrame(rows, names).repartition(5), KEYS, hot_rows=hot_rows).cache()
    found = {}
    for r in sorted(steps.collect(), key=lambda r: r.packet_number):
        found.setdefault((r.capture_id, r.client_ip), []).append((r.id_step, r.regular, r.skipped))
    assert found == {k: brute(ids) for k, ids in series.items()}
    gaps = {(r.capture_id, r.client_ip): r for r in L.transaction_gaps(steps, KEYS).collect()}
    assert (gaps["a", "c1"].gaps, gaps["a", "c1"].skipped, gaps["a", "c1"].regular_id_share) == (0, 0, 1.0)
    assert gaps["a", None].gaps == 1 and gaps["a", None].skipped == 2
    assert gaps["b", "c3"].requests == 1 and gaps["b", "c3"].regular_id_share is None


def packets(spark, rows):
    names = "capture_id string, packet_number long, us long, src_ip string, src_port int, dst_ip string, dst_port int, unit_id int, transaction_id int, packet_length int"
    return spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_micros("us")).drop("us")


def poll(capture, n, unit=lambda i: 1, length=lambda i: 60 + i % 3, answer=lambda i: True):
    """A master that asks once a second and is answered after 20 ms."""
    out = []
    for i in range(n):
        out.append((capture, 2 * i, 1_000_000 * i, "m", 9, "s", 502, unit(i), i % 65536, length(i)))
        if answer(i):
            out.append((capture, 2 * i + 1, 1_000_000 * i + 20_000, "s", 502, "m", 9, unit(i), i % 65536, length(i)))
    return out


def test_known_conversations(spark):
    rows = poll("good", 200)
    rows += poll("moved", 200, unit=lambda i: 1 if i < 100 else 2)  # other units behind the address, later
    rows += poll("grown", 200, length=lambda i: 60 if i < 100 else 200)
    rows += poll("deaf", 200, answer=lambda i: i % 2 == 0)
    rows += [("one", 1, 5, "m", 9, "s", 502, 77, 1, 60), (None, 1, 5, "m", 9, "s", 502, None, None, None)]
    found = {}
    for r in B.conversation_compliance(packets(spark, rows), 502, lag=2).collect():
        found.setdefault(r.capture_id, {})[r.criterion] = r
    good = found["good"]
    assert all(r.passed for r in good.values()), good
    assert good["response_delay_mean_ms"].observed == pytest.approx(20) and good["orphan_packet_share"].observed == 0
    assert found["moved"]["mapping_stability"].observed == 0 and not found["moved"]["mapping_stability"].passed
    assert found["grown"]["mapping_stability"].passed and found["grown"]["length_drift_sigma"].observed == pytest.approx(2, abs=0.01)
    assert found["deaf"]["orphan_packet_share"].observed == pytest.approx(100 / 300) and not found["deaf"]["orphan_packet_share"].passed
    # One packet: an orphan, and nothing else can be said.
    one = {k: r.observed for k, r in found["one"].items()}
    assert one.pop("orphan_packet_share") == 1 and set(one.values()) == {None}
    assert set(found) == {"good", "moved", "grown", "deaf", "one", None}


def test_empty_collection(spark):
    assert B.conversation_compliance(packets(spark, []), 502).count() == 0
