"""Skewed input: sliced windows, dense numbers, quantiles and pairing equal their plain forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wiregrain.operators import attacks as A
from wiregrain.operators import flows as L
from wiregrain.operators.features import fill_missing
from wiregrain.operators.fingerprint import frequency_distributions
from wiregrain.operators.quantiles import exact_quantiles
from wiregrain.operators.spread import dense_index, find_hot, ordered, with_slice
from wiregrain.operators.windows import rolling_features


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 packets: one capture has a third, with wide holes in its numbers; many are tiny."""
    i = F.col("id")
    capture = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (i % 97).cast("string")))
    number = F.when(i % 3 == 0, F.when(i < 1500, i).otherwise(i * 50)).otherwise(i)
    return (
        spark.range(3000)
        .select(
            capture.alias("capture_id"),
            number.alias("packet_number"),
            F.timestamp_micros(i * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(900_000))).alias("ts"),
            F.pmod(F.xxhash64("id"), F.lit(200)).cast("int").alias("packet_length"),
            F.pmod(F.hash("id"), F.lit(5)).alias("function_code"),
            (F.pmod(F.hash("id"), F.lit(800)) / 100).alias("payload_entropy"),
        )
        .cache()
    )


def same(a, b):
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sliced_windows_equal_plain_ones(skewed):
    plain = rolling_features(skewed, hot_rows=None)
    for limit in (5, 60, 400, 10_000):
        same(rolling_features(skewed, hot_rows=limit), plain)


def test_hot_capture_is_cut(skewed):
    assert find_hot(skewed, ["capture_id"], "packet_number", 5000) is None
    hot = find_hot(skewed, ["capture_id"], "packet_number", 100)
    assert [r["capture_id"] for r in hot.levels[0].collect()] == ["hot"]
    # Half of the hot capture lies in the first fiftieth of its range: those slices are cut again.
    assert len(hot.levels) > 1
    rows = with_slice(skewed, find_hot(skewed, ["capture_id"], "packet_number", 100))
    sizes = rows.where("capture_id = 'hot'").groupBy("__slice").count()
    assert sizes.count() > 9 and sizes.agg(F.max("count")).first()[0] <= 150
    assert rows.where("capture_id <> 'hot' AND __slice > 0").count() == 0


def test_flood_within_a_flood_is_cut(spark):
    """Three floods, each in a thousandth of the one around it."""
    orders = [i * 10**12 for i in range(50)] + [i * 10**9 for i in range(200)] + [i * 10**5 for i in range(200)] + list(range(400)) + [7] * 30
    df = spark.createDataFrame([("k", o, i) for i, o in enumerate(orders)], "k string, o long, v int")
    hot = find_hot(df, ["k"], "o", 60)
    sizes = with_slice(df, hot).groupBy("__slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 60
    args = {"keys": ["k"], "order": "o", "ties": ["v"], "carry": ["v"], "depth": 2}
    before = lambda rows, w: rows.withColumn("b", F.lag("v", 2).over(w))
    same(ordered(df, before, hot_rows=60, **args), ordered(df, before, hot_rows=None, **args))


def test_null_keys_and_negative_order(spark):
    df = spark.createDataFrame(
        [(None if i % 2 else "a", i - 50, i) for i in range(100)], "k string, o long, v int"
    )

    def compute(rows, w):
        return rows.withColumn("before", F.lag("v", 3).over(w))

    args = {"keys": ["k"], "order": "o", "carry": ["v"], "depth": 3}
    same(ordered(df, compute, hot_rows=7, **args), ordered(df, compute, hot_rows=None, **args))


def test_dense_index(skewed):
    w = Window.partitionBy("capture_id").orderBy("packet_number")
    want = skewed.withColumn("i", F.row_number().over(w).cast("long"))
    for limit in (5, 100, 10_000):
        same(dense_index(skewed, "i", keys=["capture_id"], order="packet_number", hot_rows=limit), want)


def test_forward_fill_across_slices(skewed):
    gappy = skewed.select(
        "capture_id", "packet_number", F.when(F.col("packet_length") > 185, F.col("packet_length")).alias("x")
    )
    same(fill_missing(gappy, forward=["x"], hot_rows=20), fill_missing(gappy, forward=["x"], hot_rows=None))


@pytest.mark.parametrize("shape", ["uniform", "ties", "outlier", "single"])
def test_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(7)
    n = 5000
    x = {
        "uniform": rng.normal(size=n),
        "ties": rng.integers(0, 3, n).astype(float),
        "outlier": np.r_[rng.normal(size=n - 1), 1e12],
        "single": np.full(n, 4.25),
    }[shape]
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "k int, x double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.k, r.prob): r.value for r in exact_quantiles(df, ["x"], probs, ["k"]).collect()}
    for k in (0, 1):
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(x[k::2], p), rel=1e-12, abs=1e-12)
    whole = {r.prob: r.value for r in exact_quantiles(df, ["x"], probs).collect()}
    assert whole[0.5] == pytest.approx(np.median(x))


def test_quantiles_survive_a_useless_bracket(spark, monkeypatch):
    """The sketch only steers: with brackets of no width around the wrong rank the answer stays exact."""
    from wiregrain.operators import quantiles as Q

    real = Q._brackets

    def shifted(df, keys, values, probs):
        low = F.when(F.col("prob") < 0.5, F.lit(0.0)).otherwise(F.lit(1e9))
        return real(df, keys, values, probs).withColumns({"lo": low, "hi": low + 1e-9})

    monkeypatch.setattr(Q, "_brackets", shifted)
    x = np.random.default_rng(1).normal(size=2001) * 100
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.prob: r.value for r in Q.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9]).collect()}
    for p in (0.1, 0.5, 0.9):
        assert got[p] == pytest.approx(np.quantile(x, p))


@pytest.mark.parametrize("shape", ["two modes", "powers", "one value", "flood"])
def test_quantile_bins_are_cut_until_small(spark, shape):
    """No task sorts more than ``bin_rows`` values of a rank, however the values lie, and quantiles stay exact."""
    from wiregrain.operators import quantiles as Q

    rng = np.random.default_rng(4)
    x = {
        "two modes": np.concatenate((rng.normal(size=3000) * 1e-6, 1e12 + rng.normal(size=3000))),
        "powers": 10.0 ** rng.uniform(-150, 150, 6000),
        "one value": np.full(6000, 3.5),
        "flood": np.concatenate((np.full(5000, 7.0), 7 + rng.uniform(-1e-9, 1e-9, 1000))),
    }[shape]
    rows = [("a" if i % 2 else None, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4).cache()
    probs = [0.0, 0.25, 0.49999, 0.5, 0.75, 1.0]
    long = Q._melt(df, ["k"], ["x"])
    bins = Q._narrowed(long, Q._brackets(df, ["k"], ["x"], probs), ["k", "feature"], 40).collect()
    assert all(r.c <= 40 or r.lo == r.hi for r in bins)
    assert all(sum(v < r.lo for k, v in rows if k == r.k) == r.base for r in bins)
    for r in exact_quantiles(df, ["x"], probs, ["k"], bin_rows=40).collect():
        own = [v for k, v in rows if k == r.k]
        assert r.value == pytest.approx(np.quantile(own, r.prob), rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("distinct", [9, 10, 11, 12, 300])
def test_kind_of_a_distribution_needs_no_estimate(spark, distinct):
    """Values spread over many batches; ten distinct ones are listed, eleven make a histogram."""
    x = [float(i % distinct) for i in range(3000)] + [-0.0] * 50
    df = spark.createDataFrame([("g", v) for v in x] + [("g", None)], "k string, x double").repartition(7)
    kinds = {r.kind for r in frequency_distributions(df, ["k"], ["x"]).collect()}
    assert kinds == {"value_counts" if distinct <= 10 else "hist"}


def test_histograms_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)], "k string, x double")
    rows = frequency_distributions(df, ["k"], ["x"]).collect()
    for k, values in (("b", x[::3]), ("a", np.delete(x, np.s_[::3]))):
        counts, edges = np.histogram(values, bins=10)
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.position)
        assert [r.n for r in mine] == counts.tolist()
        assert [r.bin_lo for r in mine] == pytest.approx(edges[:-1].tolist())


def test_distribution_kinds(spark):
    rows = [("g", float(i % 10), 1.0, None) for i in range(100)] + [("g", 3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, ten double, one double, none double")
    out = frequency_distributions(df, ["k"], ["ten", "one", "none"]).collect()
    kinds = {r.feature: r.kind for r in out}
    assert kinds == {"ten": "value_counts", "one": "value_counts", "none": "empty"}
    ten = sorted((r for r in out if r.feature == "ten"), key=lambda r: r.position)
    assert [r.value for r in ten][:2] == [3.0, 0.0] and ten[0].n == 11
    eleven = df.withColumn("ten", F.when(F.col("ten") == 9, 10.5).otherwise(F.col("ten"))).unionByName(
        df.limit(1).withColumn("ten", F.lit(99.0))
    )
    assert {r.kind for r in frequency_distributions(eleven, ["k"], ["ten"]).collect()} == {"hist"}


def test_pairing_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    times = np.sort(rng.integers(0, 4000, 400))
    rows = [("h" if i % 3 else "c", i, bool(rng.integers(0, 2)), int(t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, n long, q boolean, s long").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = {
        r.request_number: r.response_number
        for r in L.pair_requests(
            df, keys=["k"], is_request="q", order="n", timeout_seconds=30, cell_seconds=50
        ).collect()
    }
    for k, n, q, t in rows:
        if q:
            later = [(u, m) for j, m, p, u in rows if j == k and not p and (u, m) > (t, n) and u - t <= 30]
            assert got[n] == (min(later)[1] if later else None)


def test_periodicity_finds_the_polling_interval(spark):
    """Polls every 8 s for hours, far longer than one segment, among noise."""
    poll = spark.range(4000).select(F.lit("p").alias("k"), F.timestamp_seconds(F.col("id") * 8).alias("ts"))
    noise = spark.range(300).select(
        F.lit("p").alias("k"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(32000))).alias("ts")
    )
    r = L.fft_periodicity(poll.unionByName(noise), ["k"], 1.0, 1024).first()
    # A comb has equal power at its harmonics; the strongest line is a divisor of the interval.
    assert 8 / r.dominant_period_seconds == pytest.approx(round(8 / r.dominant_period_seconds), abs=0.05)
    assert r.power_share > 0.15


def test_fft_equals_numpy(spark):
    ticks = np.random.default_rng(2).integers(0, 256, 500)
    df = spark.createDataFrame([("a", int(t)) for t in ticks], "k string, s long").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    counts = np.bincount(ticks, minlength=256).astype(float)
    power = np.abs(np.fft.rfft(counts - counts.mean()))[1:] ** 2
    r = L.fft_periodicity(df, ["k"], 1.0, 256).first()
    assert r.dominant_period_seconds == pytest.approx(256 / (power.argmax() + 1))
    assert r.power_share == pytest.approx(power.max() / power.sum())


def test_autocorrelation_of_alternating_gaps(spark):
    df = spark.range(400).select(
        F.lit("a").alias("k"), F.col("id").alias("packet_number"), F.timestamp_seconds((F.col("id") / 2).cast("long") * 5 + F.col("id") % 2).alias("ts")
    )
    even = L.iat_autocorrelation(df, 2, ["k"], hot_rows=50).first()
    odd = L.iat_autocorrelation(df, 1, ["k"], hot_rows=50).first()
    assert even.autocorrelation == pytest.approx(1.0) and even.is_periodic
    assert odd.autocorrelation == pytest.approx(-1.0, abs=1e-3) and not odd.is_periodic


def test_detection_matching_counts_boundaries(spark):
    ts = F.timestamp_micros
    packets = spark.createDataFrame([(i * 1_000_000, "P1" if i != 3 else "N") for i in range(10)], "us long, prediction string")
    packets = packets.select(F.lit("c").alias("capture_id"), ts("us").alias("ts"), "prediction")
    events = spark.createDataFrame([(1, 5_000_000, "P1_APT"), (2, 2_500_000, "P1_APT"), (3, 5_000_000, "P2_Insider")], "event_id long, us long, attacker_profile_id string")
    events = events.select(F.lit("c").alias("capture_id"), "event_id", ts("us").alias("ts"), "attacker_profile_id")
    got = {r.event_id: r.detected_packets for r in A.match_detections(packets, events, 2.0, 3.0).collect()}
    assert got == {1: 4, 2: 3, 3: 0}


def test_flow_counts_with_a_hot_source_broadcast_only_what_is_small(spark, skewed):
    """With broadcasts switched off the same rows come from sort-merge joins."""
    from wiregrain.operators.features import flow_features

    rows = skewed.select(
        "*",
        F.lit("10.0.0.1").alias("src_ip"),
        F.col("function_code").cast("string").alias("dst_ip"),
        F.col("function_code").alias("unit_id"),
        F.lit(1).alias("is_read_operation"),
        F.lit(0).alias("is_write_operation"),
    )
    small = flow_features(rows)
    a = small.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = flow_features(rows).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, a)) == sorted(map(repr, b))
