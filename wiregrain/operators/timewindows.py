"""Clock-time windows. The same functions serve batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wiregrain.operators.spread import HOT_ROWS, ordered, running_max
from wiregrain.session import settle

#: Rows of steps and address combinations that a task copies into their windows.
STEP_ROWS = 250_000

_SIDES = {
    "src_ip": "unique_src_ips",
    "dst_ip": "unique_dst_ips",
    "unit_id": "unique_unit_ids",
    "function_code": "unique_function_codes",
}


def _invalid() -> Column:
    return ~F.coalesce(F.col("is_valid"), F.lit(False))


def _span(width: str, slide: str | None) -> Column:
    return (F.window("ts", width, slide) if slide else F.window("ts", width)).alias("w")


def window_metrics(
    df: DataFrame,
    width: str = "60 seconds",
    slide: str | None = "10 seconds",
    keys: Sequence[str] = (),
    late: str | None = None,
) -> DataFrame:
    """Packet counts, address topology and violation rate per window (``slide`` divides ``width``).

    Packets are first summed per slide step, so that overlapping windows copy those sums and not the packets. On a stream
    ``late`` sets the watermark; a step is one row of state with its distinct addresses, units and codes, which the windows
    unite when it closes, so a row of state grows with the different values of one window, not with its packets. In batch a
    step has a row for each address combination, and the copies are made in tasks of ``STEP_ROWS`` such rows.
    """
    sums = [F.sum(c).alias(c) for c in ("packets", "bytes", "violations")]
    first = [F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"), F.count_if(_invalid()).alias("violations")]
    if df.isStreaming:
        rows = df.withWatermark("ts", late) if late else df
        out = rows.groupBy(*keys, _span(slide or width, None)).agg(*first, *[F.collect_set(c).alias(c) for c in _SIDES])
        if slide:
            # A window of windows goes by their ends, so the watermark is carried on.
            spans = F.window("w", width, slide).alias("w")
            united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in _SIDES]
            out = out.groupBy(*keys, spans).agg(*sums, *united)
        out = out.withColumns({name: F.size(c).cast("long") for c, name in _SIDES.items()})
    else:
        step = settle(df.groupBy(*keys, *_SIDES, F.window("ts", slide or width)["start"].alias("ts")).agg(*first))
        if slide:
            tasks = max(-(-step.count() // STEP_ROWS), df.sparkSession.sparkContext.defaultParallelism)
            step = step.repartition(tasks, *keys, *_SIDES, "ts")
        combos = step.groupBy(*keys, *_SIDES, _span(width, slide)).agg(*sums)
        out = combos.groupBy(*keys, "w").agg(*sums, *[F.countDistinct(c).alias(name) for c, name in _SIDES.items()])
    out = out.withColumn("violation_rate", F.col("violations") / F.col("packets"))
    return out.select(
        *keys,
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "packets",
        "bytes",
        *_SIDES.values(),
        "violations",
        "violation_rate",
    )


def window_codes(
    df: DataFrame, width: str = "60 seconds", slide: str | None = "10 seconds", late: str | None = None
) -> DataFrame:
    """Function-code counts per window."""
    if late and df.isStreaming:
        df = df.withWatermark("ts", late)
    out = df.groupBy(_span(width, slide), "function_code").agg(F.count(F.lit(1)).alias("packets"))
    return out.select(F.col("w.start").alias("window_start"), "function_code", "packets")


def tumbling_metrics(
    df: DataFrame, width: str = "5 minutes", keys: Sequence[str] = (), late: str | None = None
) -> DataFrame:
    return window_metrics(df, width, None, keys, late)


def with_session(
    df: DataFrame,
    keys: Sequence[str],
    gap: str = "30 minutes",
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Batch: ``session_start`` of the session each packet belongs to.

    ``session_window`` sorts every key within one task. Here starts are found by a
    one-row look back and carried on as a running maximum, both over slices of hot keys.
    """
    rows = df.withColumn("__us", F.unix_micros("ts"))

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        ends = F.timestamp_micros(F.lag("__us").over(w)) + F.expr(f"interval {gap}")
        fresh = F.coalesce(F.timestamp_micros("__us") >= ends, F.lit(True))
        return rows.withColumn("__start", F.when(fresh, F.col("__us")))

    marked = ordered(
        rows, compute, keys=keys, order="__us", ties=[order], depth=1, hot_rows=hot_rows
    )
    # The running maximum reads its input three times.
    marked = settle(marked)
    done = running_max(
        marked, "__start", "__at", keys=keys, order="__us", hot_rows=hot_rows or HOT_ROWS
    )
    return done.withColumn("session_start", F.timestamp_micros("__at")).drop("__us", "__start", "__at")


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    gap: str = "30 minutes",
    late: str | None = None,
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Sessions split by a silent gap: packets, duration, bytes; streams use Spark's session state."""
    if df.isStreaming:
        rows = df.withWatermark("ts", late) if late else df
        span = F.session_window("ts", gap)
        grouped, start = rows.groupBy(*keys, span.alias("w")), F.col("w.start")
    else:
        rows = df.select(*keys, order, "ts", "packet_length")
        rows = with_session(rows, keys, gap, order, hot_rows)
        grouped, start = rows.groupBy(*keys, "session_start"), F.col("session_start")
    out = grouped.agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("packet_length").alias("bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return out.select(
        *keys,
        start.alias("session_start"),
        "packets",
        "bytes",
        ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6).alias("duration_seconds"),
    )


def session_codes(
    df: DataFrame,
    keys: Sequence[str],
    gap: str = "30 minutes",
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
    late: str | None = None,
) -> DataFrame:
    """Sessions with their dominant function code, smallest on ties.

    On a stream each open session keeps the counts of its codes, which are added when sessions merge.
    """
    if df.isStreaming:
        rows = df.withWatermark("ts", late) if late else df
        out = rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
            F.count(F.lit(1)).alias("packets"), F.mode("function_code", True).alias("dominant_fc")
        )
        return out.select(*keys, F.col("w.start").alias("session_start"), "packets", "dominant_fc")
    rows = df.select(*keys, order, "ts", "function_code")
    rows = with_session(rows, keys, gap, order, hot_rows)
    counts = rows.groupBy(*keys, "session_start", "function_code").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("function_code")).alias("neg")))
    return counts.groupBy(*keys, "session_start").agg(
        F.sum("n").alias("packets"), (-best["neg"]).alias("dominant_fc")
    )
