"""Per-flow metrics, request/response pairing and periodicity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wiregrain.operators.spread import HOT_ROWS, SLICE, find_hot, join_null_safe, ordered, with_slice
from wiregrain.operators.windows import rolling_features, time_gap

FLOW = ["capture_id", "ip_a", "port_a", "ip_b", "port_b"]


def with_flow(df: DataFrame) -> DataFrame:
    """Endpoints in a fixed order plus ``forward``: 1 when the packet travels from a to b."""
    src, dst = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    forward = src <= dst
    return df.withColumns(
        {
            "ip_a": F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "port_a": F.when(forward, F.col("src_port")).otherwise(F.col("dst_port")),
            "ip_b": F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip")),
            "port_b": F.when(forward, F.col("dst_port")).otherwise(F.col("src_port")),
            "forward": forward.cast("int"),
        }
    )


def flow_metrics(df: DataFrame) -> DataFrame:
    """Packets, duration, direction balance, dominant code and code diversity of each flow.

    Counts per (flow, code) come first; at most 256 of those make a flow, however large it is.
    """
    us = F.unix_micros("ts")
    by_code = (
        with_flow(df)
        .groupBy(*FLOW, "function_code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("forward").alias("fwd"),
            F.min(us).alias("first_us"),
            F.max(us).alias("last_us"),
        )
    )
    known = F.col("function_code").isNotNull()
    best = F.max(F.when(known, F.struct("n", (-F.col("function_code")).alias("neg"))))
    packets, fwd = F.sum("n"), F.sum("fwd")
    return by_code.groupBy(*FLOW).agg(
        packets.alias("packets"),
        ((F.max("last_us") - F.min("first_us")) / 1e6).alias("duration_seconds"),
        fwd.alias("forward_packets"),
        (packets - fwd).alias("backward_packets"),
        (fwd / F.nullif(packets - fwd, F.lit(0))).alias("forward_backward_ratio"),
        ((fwd > 0) & (fwd < packets)).alias("is_bidirectional"),
        (-best["neg"]).alias("dominant_fc"),
        (best["n"] / packets).alias("dominant_fc_share"),
        F.count_if(known).alias("fc_diversity"),
    )


def iat_shape(
    df: DataFrame, keys: Sequence[str], order: str = "packet_number", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Skewness, variation, burst ratio (max over mean) and jitter of inter-arrival times per key."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("iat", time_gap(F.col("ts"), w))

    gaps = ordered(
        df.select(*keys, order, "ts"),
        compute,
        keys=keys,
        order=order,
        carry=["ts"],
        depth=1,
        hot_rows=hot_rows,
    )
    mean = F.nullif(F.avg("iat"), F.lit(0.0))
    # Skewness of a series without spread is undefined.
    skew = F.when(F.stddev_pop("iat") > 0, F.skewness("iat"))
    return gaps.groupBy(*keys).agg(
        F.count("iat").alias("intervals"),
        (F.avg("iat") * 1000).alias("iat_mean_ms"),
        (F.stddev_samp("iat") * 1000).alias("iat_std_ms"),
        skew.alias("iat_skewness"),
        (F.stddev_samp("iat") / mean).alias("iat_cv"),
        (F.max("iat") / mean).alias("iat_max_over_mean"),
        (F.stddev_pop("iat") / mean).alias("iat_jitter"),
    )


def iat_autocorrelation(
    df: DataFrame,
    lag: int,
    keys: Sequence[str],
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Correlation of inter-arrival times with themselves ``lag`` packets earlier; above 0.7 is periodic."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("iat", time_gap(F.col("ts"), w))
        return rows.withColumn("iat_before", F.lag("iat", lag).over(w))

    pairs = ordered(
        df.select(*keys, order, "ts"),
        compute,
        keys=keys,
        order=order,
        carry=["ts"],
        depth=lag + 1,
        hot_rows=hot_rows,
    ).where(F.col("iat").isNotNull() & F.col("iat_before").isNotNull())
    spread = (F.stddev_pop("iat") > 0) & (F.stddev_pop("iat_before") > 0)
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.when(spread, F.corr("iat", "iat_before")).alias("autocorrelation"),
    )
    periodic = F.coalesce(F.col("autocorrelation") > 0.7, F.lit(False))
    return out.withColumn("is_periodic", periodic)


def fc_behaviour(
    df: DataFrame, keys: Sequence[str], order: str = "packet_number", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Share of sequential code changes and mean ten-packet stability per key."""
    rows = rolling_features(
        df.select(*keys, order, "function_code"),
        ["function_code"],
        keys=keys,
        order=order,
        hot_rows=hot_rows,
    )
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.avg("function_code_changes").alias("fc_change_share"),
        F.avg("function_code_stability_10").alias("fc_stability"),
    )


def pair_requests(
    messages: DataFrame,
    *,
    keys: Sequence[str],
    is_request: str = "is_request",
    order: str = "packet_number",
    timeout_seconds: float = 10.0,
    cell_seconds: float = 60.0,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each request with the earliest response at or after it within the timeout.

    A look-ahead over time-ordered rows instead of a self-join, so a busy key never
    multiplies. Keys are cut into time cells; a response in the first ``timeout`` of a
    cell is also shown to the cell before, which is all a request there can reach.
    A cell above ``hot_rows`` is cut into slices, and the first response of the slices behind
    is handed to each slice, one row for a slice. ``hot_rows=None`` says that no cell is large.
    """
    timeout, cell = int(timeout_seconds * 1e6), int(max(cell_seconds, timeout_seconds) * 1e6)
    rows = messages.select(
        *keys, order, is_request, F.unix_micros("ts").alias("us")
    ).withColumn("cell", F.floor(F.col("us") / cell))
    early = (~F.col(is_request)) & (F.col("us") - F.col("cell") * cell <= timeout)
    shown = rows.unionByName(rows.where(early).withColumn("cell", F.col("cell") - 1))
    # Looking ahead is looking back in the opposite order, which runs in one pass.
    cells = [*keys, "cell"]
    hot = None if hot_rows is None else find_hot(shown, cells, "us", hot_rows)
    back = (
        Window.partitionBy(*cells, SLICE)
        .orderBy(F.col("us").desc(), F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reply = F.when(~F.col(is_request), F.struct(F.col("us").alias("us"), F.col(order).alias("number")))
    found = with_slice(shown, hot).withColumn("reply", F.last(reply, ignorenulls=True).over(back)).where(is_request)
    if hot is not None:
        firsts = with_slice(shown, hot, only_hot=True).groupBy(*cells, SLICE).agg(F.min(reply).alias("first"))
        behind = Window.partitionBy(*cells).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
        handed = firsts.select(*cells, SLICE, F.last("first", ignorenulls=True).over(behind).alias("handed"))
        found = join_null_safe(found, handed, [*cells, SLICE]).withColumn("reply", F.coalesce("reply", "handed"))
    in_time = F.col("reply.us") - F.col("us") <= timeout
    return found.select(
        *keys,
        F.col(order).alias("request_number"),
        F.when(in_time, F.col("reply.number")).alias("response_number"),
        F.when(in_time, (F.col("reply.us") - F.col("us")) / 1000).alias("response_delay_ms"),
    )


def modbus_messages(decoded: DataFrame, port: int) -> DataFrame:
    """Requests go to the protocol port, responses come from it; both share the client endpoint."""
    request = F.col("dst_port") == port
    return decoded.withColumns(
        {
            "is_request": request,
            "client_ip": F.when(request, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "client_port": F.when(request, F.col("src_port")).otherwise(F.col("dst_port")),
            "server_ip": F.when(request, F.col("dst_ip")).otherwise(F.col("src_ip")),
        }
    )


MESSAGE_KEYS = ["capture_id", "client_ip", "client_port", "server_ip", "unit_id", "transaction_id"]


def pairing_summary(messages: DataFrame, pairs: DataFrame, is_request: str = "is_request") -> DataFrame:
    """Per capture: requests, responses, their ratio, orphaned requests and mean delay."""
    sides = messages.groupBy("capture_id").agg(
        F.count_if(F.col(is_request)).alias("requests"),
        F.count_if(~F.col(is_request)).alias("responses"),
    )
    delay = F.col("response_delay_ms")
    matched = pairs.groupBy("capture_id").agg(
        F.count_if(delay.isNull()).alias("orphaned_requests"), F.avg(delay).alias("mean_delay_ms")
    )
    out = sides.join(matched, "capture_id", "left").fillna(0, ["orphaned_requests"])
    return out.withColumns(
        {
            "request_response_ratio": F.col("requests") / F.nullif(F.col("responses"), F.lit(0)),
            "orphan_share": F.col("orphaned_requests") / F.nullif(F.col("requests"), F.lit(0)),
        }
    )


def transaction_steps(
    messages: DataFrame,
    keys: Sequence[str] = ("capture_id", "client_ip", "client_port", "server_ip"),
    is_request: str = "is_request",
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each request's step from the transaction id before it in its conversation, which wraps at 65,536.

    A step is regular when it is one (sequential ids) or the step before it again (ids that are constant or go by
    another stride); ids between that a regular sequence would have held are ``skipped``. The first request has no step.
    """

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        ids = F.col("transaction_id")
        # Both from the ids themselves: rows carried into a slice have no computed columns.
        return rows.withColumns(
            {
                "id_step": F.pmod(ids - F.lag(ids).over(w), F.lit(65536)),
                "__before": F.pmod(F.lag(ids).over(w) - F.lag(ids, 2).over(w), F.lit(65536)),
            }
        )

    requests = messages.where(is_request).select(*keys, order, F.col("transaction_id").cast("long").alias("transaction_id"))
    rows = ordered(requests, compute, keys=keys, order=order, carry=["transaction_id"], depth=2, hot_rows=hot_rows)
    step, regular = F.col("id_step"), (F.col("id_step") == 1) | F.coalesce(F.col("id_step") == F.col("__before"), F.lit(False))
    skipped = F.when(step.isNotNull(), F.when(regular, 0).otherwise(F.greatest(step - 1, F.lit(0))))
    return rows.withColumns({"regular": regular, "skipped": skipped.cast("long")}).drop("__before")


def transaction_gaps(steps: DataFrame, keys: Sequence[str] = ("capture_id", "client_ip", "client_port", "server_ip")) -> DataFrame:
    """Per conversation: requests, irregular steps, skipped ids and the share of regular steps (NULL without a step)."""
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("regular")).alias("gaps"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
        F.avg(F.col("regular").cast("int")).alias("regular_id_share"),
    )


# --- periodicity by Fourier transform -------------------------------------------


def packet_series(df: DataFrame, keys: Sequence[str], bin_seconds: float, segment_bins: int) -> DataFrame:
    """Packets per fixed time bin, numbered within segments of ``segment_bins`` bins."""
    width = int(bin_seconds * 1e6)
    tick = F.floor(F.unix_micros("ts") / width)
    counts = df.groupBy(*keys, tick.alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        *keys,
        F.floor(F.col("tick") / segment_bins).alias("segment"),
        F.pmod("tick", F.lit(segment_bins)).cast("int").alias("slot"),
        "n",
    )


def fft_periodicity(
    df: DataFrame, keys: Sequence[str], bin_seconds: float = 1.0, segment_bins: int = 1024
) -> DataFrame:
    """Dominant period and its share of power per key.

    Packets are counted per time bin by Spark; only a segment of at most
    ``segment_bins`` counts reaches numpy at a time. Segment spectra are then
    averaged by an ordinary aggregation, so the length of a flow does not matter.
    """
    series = packet_series(df, keys, bin_seconds, segment_bins)
    half = segment_bins // 2
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*keys).schema)

    def spectrum(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(segment_bins)
        counts[pdf["slot"].to_numpy()] = pdf["n"].to_numpy()
        power = np.abs(np.fft.rfft(counts - counts.mean()))[1 : half + 1] ** 2
        out = pd.DataFrame({"frequency": np.arange(1, half + 1, dtype="int32"), "power": power})
        for name, value in zip(keys, key):
            out.insert(len(out.columns) - 2, name, value)
        return out

    power = (
        series.groupBy(*keys, "segment")
        .applyInPandas(spectrum, f"{fields}, frequency int, power double")
        .groupBy(*keys, "frequency")
        .agg(F.sum("power").alias("power"))
    )
    best = F.max(F.struct("power", (-F.col("frequency")).alias("neg")))
    total = F.nullif(F.sum("power"), F.lit(0.0))
    return power.groupBy(*keys).agg(
        (F.lit(bin_seconds * segment_bins) / -best["neg"]).alias("dominant_period_seconds"),
        F.coalesce(best["power"] / total, F.lit(0.0)).alias("power_share"),
    )
