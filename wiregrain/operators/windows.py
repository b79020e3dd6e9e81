"""Per-packet features over the last ten packets, in capture order.

Frames follow ``(capture_id, packet_number)``, not the clock, so a time delta may
be negative. All groups asked for share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wiregrain.constants import BURST_MS, BURST_RUN
from wiregrain.operators.spread import HOT_ROWS, ordered

FRAME = 10
_TINY = 1e-9

# What each group reads besides the key and order columns.
GROUPS = {
    "timing": "ts",
    "size": "packet_length",
    "entropy": "payload_entropy",
    "function_code": "function_code",
}


def _rolling(column: str, w10: WindowSpec) -> dict[str, Column]:
    return {
        f"{column}_mean_10": F.avg(column).over(w10),
        f"{column}_std_10": F.stddev_samp(column).over(w10),
        f"{column}_min_10": F.min(column).over(w10),
        f"{column}_max_10": F.max(column).over(w10),
    }


def _cv(column: str) -> Column:
    return F.coalesce(F.col(f"{column}_std_10") / (F.col(f"{column}_mean_10") + _TINY), F.lit(0.0))


def time_gap(ts: Column, w: WindowSpec) -> Column:
    """Seconds since the previous row, from whole microseconds; NULL on the first row."""
    return (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)) / 1e6


def rolling_features(
    df: DataFrame,
    groups: Sequence[str] = tuple(GROUPS),
    *,
    keys: Sequence[str] = ("capture_id",),
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add the rolling columns of the named groups."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        w10 = w.rowsBetween(1 - FRAME, 0)
        base: dict[str, Column] = {}
        if "timing" in groups:
            base["time_delta"] = time_gap(F.col("ts"), w)
        if "function_code" in groups:
            # A NULL code never equals its neighbour; the first row counts as a change.
            same = F.col("function_code") == F.lag("function_code").over(w)
            base["function_code_changes"] = 1 - F.coalesce(same.cast("int"), F.lit(0))
        rows = rows.withColumns(base)

        out: dict[str, Column] = {}
        if "timing" in groups:
            out["time_delta_ms"] = F.col("time_delta") * 1000
            out |= _rolling("time_delta", w10)
            fast = F.coalesce((F.col("time_delta") * 1000 < BURST_MS).cast("int"), F.lit(0))
            out["burst_streak"] = F.sum(fast).over(w10)
        if "size" in groups:
            out |= _rolling("packet_length", w10)
        if "entropy" in groups:
            out |= _rolling("payload_entropy", w10)
        if "function_code" in groups:
            out["function_code_stability_10"] = 1 - F.avg("function_code_changes").over(w10)
        rows = rows.withColumns(out)

        last: dict[str, Column] = {}
        if "timing" in groups:
            last["time_delta_cv_10"] = _cv("time_delta")
            last["burst_indicator"] = F.coalesce(
                (F.col("time_delta_ms") < 5).cast("int"), F.lit(0)
            )
            last["periodicity_score"] = 1 - _cv("time_delta")
            last["is_burst"] = F.col("burst_streak") >= BURST_RUN
        if "size" in groups:
            last["packet_length_cv_10"] = _cv("packet_length")
        return rows.withColumns(last)

    return ordered(
        df,
        compute,
        keys=keys,
        order=order,
        carry=[GROUPS[g] for g in groups],
        depth=FRAME,
        hot_rows=hot_rows,
    )


def timing_features(df: DataFrame, **where) -> DataFrame:
    return rolling_features(df, ["timing"], **where)


def size_features(df: DataFrame, **where) -> DataFrame:
    return rolling_features(df, ["size"], **where)


def entropy_rolling(df: DataFrame, **where) -> DataFrame:
    return rolling_features(df, ["entropy"], **where)


def function_code_rolling(df: DataFrame, **where) -> DataFrame:
    return rolling_features(df, ["function_code"], **where)


def inter_arrival(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("capture_id",),
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """``inter_arrival_time`` in seconds, 0.0 on the first packet."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn(
            "inter_arrival_time", F.coalesce(time_gap(F.col("ts"), w), F.lit(0.0))
        )

    return ordered(
        df, compute, keys=keys, order=order, carry=["ts"], depth=1, hot_rows=hot_rows
    )
