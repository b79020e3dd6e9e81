"""What the scored packets of a capture say: summary, state transitions and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from wiregrain.constants import LABELS
from wiregrain.operators.distributions import histogram
from wiregrain.operators.spread import HOT_ROWS, join_null_safe, ordered


def transitions(
    scored: DataFrame,
    keys: Sequence[str] = ("capture_id",),
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Packets whose prediction differs from that of the packet before."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("from_label", F.lag("prediction").over(w))

    moved = ordered(
        scored.select(*keys, order, "ts", "prediction"),
        compute,
        keys=keys,
        order=order,
        carry=["prediction"],
        depth=1,
        hot_rows=hot_rows,
    ).where(F.col("from_label") != F.col("prediction"))
    return moved.select(*keys, order, "ts", "from_label", F.col("prediction").alias("to_label"))


def first_transitions(
    moves: DataFrame, n: int = 10, order: str = "packet_number", keys: Sequence[str] = ("capture_id",)
) -> DataFrame:
    """The first ``n`` by number, then by capture."""
    return moves.orderBy(order, *[k for k in keys if k in moves.columns]).limit(n)


def count_windows(
    scored: DataFrame, keys: Sequence[str] = ("capture_id",), position: str = "packet_number"
) -> DataFrame:
    """Half-overlapping windows of ``max(100, n/20)`` packets: mean time, attack ratio, mean confidence.

    ``position`` is the dense 1-based packet number. A row belongs to three windows at
    most, and a capture has about forty of them, so partial aggregation shrinks it at once.
    Captures of at most one window's length give no row.
    """
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__size", F.greatest(F.lit(100), F.expr("__n div 20")).cast("long"))
    sizes = sizes.withColumn("__hop", F.expr("__size div 2"))
    i = F.col(position) - 1
    first = F.greatest(F.lit(0), F.ceil((i - F.col("__size") + 1) / F.col("__hop")))
    last = F.least(
        F.floor(i / F.col("__hop")), F.ceil((F.col("__n") - F.col("__size")) / F.col("__hop")) - 1
    )
    rows = (
        join_null_safe(scored, sizes, keys, "inner")
        .withColumns({"__first": first, "__last": last})
        .where(F.col("__first") <= F.col("__last"))
        .withColumn("window_number", F.explode(F.sequence("__first", "__last")))
    )
    return rows.groupBy(*keys, "window_number").agg(
        F.count(F.lit(1)).alias("packets"),
        F.avg(F.unix_micros("ts") / 1e6).alias("center_time"),
        F.avg((F.col("prediction") != "N").cast("int")).alias("attack_ratio"),
        F.avg("confidence").alias("avg_confidence"),
    )


def confidence_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(scored, "confidence", bins, ["prediction"])


def capture_verdicts(scored: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per capture: attack flag, labels present in class order, counts, confidence, transitions."""
    per_label = {
        f"packets_{name}": F.count_if(F.col("prediction") == name) for name in LABELS
    }
    base = scored.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"),
        *[c.alias(name) for name, c in per_label.items()],
        F.avg("confidence").alias("mean_confidence"),
        F.sum("is_modbus").alias("modbus_packets"),
        F.sum("is_tcp").alias("tcp_packets"),
        F.sum("is_udp").alias("udp_packets"),
    )
    present = F.array(*[F.when(F.col(f"packets_{n}") > 0, n) for n in LABELS])
    base = base.withColumns(
        {
            "attack_detected": (F.col("packets_N") < F.col("packets")).cast("int"),
            "labels_present": F.array_join(F.array_compact(present), ", "),
            **{f"pct_{n}": F.col(f"packets_{n}") / F.col("packets") * 100 for n in LABELS},
        }
    )
    moves = transitions(scored, hot_rows=hot_rows).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("transitions")
    )
    return base.join(moves, "capture_id", "left").fillna(0, ["transitions"])
