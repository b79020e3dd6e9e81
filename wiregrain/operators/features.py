"""Packet features that are not row windows, and the full feature chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.constants import MODBUS_UNIT_RANGE
from wiregrain.functions.entropy import classify_entropy, is_entropy_normal, packet_entropy
from wiregrain.functions.text import epoch_seconds
from wiregrain.operators.decode import Protocol
from wiregrain.operators.spread import HOT_ROWS, SLICE, find_hot, join_null_safe, with_slice
from wiregrain.operators.windows import rolling_features
from wiregrain.session import settle


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def entropy_features(df: DataFrame, protocol: Protocol, raw: str = "payload") -> DataFrame:
    """Payload, header and full-packet entropy with class and normal flag."""
    out = df.withColumn("__e", packet_entropy(F.col(raw), protocol.data_offset))
    return (
        out.select("*", "__e.*")
        .drop("__e")
        .withColumn("entropy_classification", classify_entropy(F.col("payload_entropy")))
        .withColumn("is_normal_entropy", is_entropy_normal(F.col("payload_entropy")))
    )


def operation_flags(df: DataFrame, protocol: Protocol) -> DataFrame:
    code = F.col("function_code")
    return df.withColumns(
        {
            "is_read_operation": _flag(code.isin(protocol.reads)),
            "is_write_operation": _flag(code.isin(protocol.writes)),
            "is_error_response": _flag(code >= 128),
        }
    )


def validation_flags(df: DataFrame, protocol: Protocol) -> DataFrame:
    """Protocol id, unit, function code and length checks as 0/1, NULL counting as 0."""
    length, data, unit = F.col("modbus_length"), F.col("data_length"), F.col("unit_id")
    if protocol.name == "modbus":
        unit_ok, length_ok = unit.between(*MODBUS_UNIT_RANGE), length == data + 2
    else:
        unit_ok, length_ok = unit >= 0, F.abs(length - data) <= 5
    return df.withColumns(
        {
            "protocol_id_valid": _flag(F.col("protocol_id") == 0),
            "unit_id_valid": _flag(unit_ok),
            "function_code_valid": _flag(F.col("function_code").between(*protocol.code_range)),
            "length_consistent": _flag(length_ok),
        }
    )


def one_hot(
    df: DataFrame, codes: Sequence[int] | None = None, column: str = "function_code", prefix: str = "fc"
) -> DataFrame:
    """Indicator per code. Without a list, the codes present are looked up first (batch only).

    Only a column of one-byte codes is looked up; for one with more than 256 values give the list.
    """
    if codes is None:
        present = sorted(r[0] for r in df.select(column).dropna().distinct().limit(257).collect())
        if len(present) > 256:
            raise ValueError(f"{column} has more than 256 values: say for which ones")
        codes = present
    return df.withColumns({f"{prefix}_{c}": _flag(F.col(column) == c) for c in codes})


# --- capture-wide counts -------------------------------------------------------

_SIDES = {"src": "src_ip", "dst": "dst_ip", "unit": "unit_id"}


def flow_profile(df: DataFrame) -> DataFrame:
    """Packet counts per capture and per source, destination and unit, from one scan.

    Grouping sets pre-aggregate on the map side, so a source with a third of all
    packets sends a handful of partial counts. The result is settled, partitioned by ``side``.
    """
    c = F.col("capture_id")
    sets = [[c], *[[c, F.col(s)] for s in _SIDES.values()]]
    level = F.grouping_id("capture_id", *_SIDES.values())
    names = {0b0111: "capture", 0b0011: "src", 0b0101: "dst", 0b0110: "unit"}
    side = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    counts = df.groupingSets(sets, c, *[F.col(s) for s in _SIDES.values()]).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("is_read_operation").alias("reads"),
        F.sum("is_write_operation").alias("writes"),
        level.cast("int").alias("level"),
    )
    return settle(counts.withColumn("side", side[F.col("level")]).drop("level"), "side")


def flow_features(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Counts per source, destination and unit, and the number of distinct ones, on every row.

    The joined tables are settled with known sizes, so Spark broadcasts them when
    they are small and otherwise runs a sort-merge join whose hot keys the adaptive skew rule splits.
    """
    profile = flow_profile(df) if profile is None else profile
    for side, column in _SIDES.items():
        counts = profile.where((F.col("side") == side) & F.col(column).isNotNull())
        counts = counts.select("capture_id", column, F.col("n").alias(f"packets_per_{side}"))
        df = df.join(counts, ["capture_id", column], "left")
    unique = profile.where(F.col("side") != "capture").groupBy("capture_id").agg(
        *[
            F.count_if((F.col("side") == side) & F.col(column).isNotNull()).alias(
                f"unique_{column}s"
            )
            for side, column in _SIDES.items()
        ]
    )
    return df.join(settle(unique), "capture_id", "left")


def derived_features(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Entropy stability per row; read/write ratio and packet rate of the capture."""
    profile = flow_profile(df) if profile is None else profile
    seconds = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    whole = profile.where(F.col("side") == "capture").select(
        "capture_id",
        (F.col("reads") / F.greatest("writes", F.lit(1))).alias("read_write_ratio"),
        (F.col("n") / F.greatest(seconds, F.lit(1.0))).alias("traffic_intensity"),
    )
    out = df.join(whole, "capture_id", "left")
    if "payload_entropy_std_10" in df.columns:
        calm = 1 / (1 + F.coalesce(F.col("payload_entropy_std_10"), F.lit(0.0)))
        out = out.withColumn("entropy_stability", calm)
    return out


def all_features(
    decoded: DataFrame,
    protocol: Protocol,
    codes: Sequence[int] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The whole chain on decoded packets: entropy, timing, size, function code, validation, flow, derived.

    The payload is read once: entropies and flags come first and are settled without the
    raw bytes, and every later pass (counts, hot keys, windows) reads that narrow table.
    ``codes`` fixes the one-hot columns; the protocol's known codes are the default,
    so the schema does not depend on the data.
    """
    flagged = (
        decoded.withColumn("timestamp", epoch_seconds(F.col("ts")))
        .transform(operation_flags, protocol)
        .transform(validation_flags, protocol)
        .transform(one_hot, sorted(protocol.functions) if codes is None else codes)
        .transform(entropy_features, protocol)
    )
    narrow = settle(flagged.drop("payload", "data"))
    profile = flow_profile(narrow)
    return (
        narrow.transform(rolling_features, hot_rows=hot_rows)
        .transform(flow_features, profile)
        .transform(derived_features, profile)
    )


_NOT_NUMERIC_FEATURES = {
    "capture_id",
    "packet_number",
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "function_name",
    "entropy_classification",
    "is_normal_entropy",
    "is_burst",
    "burst_streak",
}


def numeric_columns(df: DataFrame, without: set[str] = frozenset()) -> list[str]:
    """Numeric and boolean columns, in schema order."""
    kinds = (T.NumericType, T.BooleanType)
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in without
    ]


def feature_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric features as doubles, NULL as 0, plus the assembled vector ``features``."""
    columns = list(columns or numeric_columns(df, _NOT_NUMERIC_FEATURES))
    ids = [c for c in ("capture_id", "packet_number") if c in df.columns]
    zeroed = df.select(
        *ids, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    )
    return VectorAssembler(inputCols=columns, outputCol="features").transform(zeroed)


# --- normalisation and missing values ------------------------------------------


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean, sample deviation, minimum and maximum of each column."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_avg"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).cast("double").alias(f"{c}_lo"),
            F.max(c).cast("double").alias(f"{c}_hi"),
        ]
    return df.agg(F.struct(*aggs).alias("s")).select("s")


def normalise(
    df: DataFrame,
    zscore: Sequence[str] = (),
    minmax: Sequence[str] = (),
    log: Sequence[str] = (),
) -> DataFrame:
    """``<c>_z``, ``<c>_scaled`` and ``<c>_log`` columns; a constant column scales to 0."""
    columns = list(dict.fromkeys([*zscore, *minmax]))
    out = {}
    if columns:
        s = column_stats(df, columns).scalar()
        for c in zscore:
            spread = F.nullif(s[f"{c}_std"], F.lit(0.0))
            value = F.coalesce((F.col(c) - s[f"{c}_avg"]) / spread, F.lit(0.0))
            out[f"{c}_z"] = F.when(F.col(c).isNotNull(), value)
        for c in minmax:
            span = F.nullif(s[f"{c}_hi"] - s[f"{c}_lo"], F.lit(0.0))
            value = F.coalesce((F.col(c) - s[f"{c}_lo"]) / span, F.lit(0.0))
            out[f"{c}_scaled"] = F.when(F.col(c).isNotNull(), value)
    out |= {f"{c}_log": F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in log}
    return df.withColumns(out)


def fill_missing(
    df: DataFrame,
    forward: Sequence[str] = (),
    zero: Sequence[str] = (),
    mean: Sequence[str] = (),
    *,
    keys: Sequence[str] = ("capture_id",),
    order: str = "packet_number",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Missing-value policy: last known value, then 0 where there is no history, mean elsewhere.

    A forward fill may reach back any distance, so each slice of a hot key
    carries one row in, and that row must already be filled: slice ends are filled first.
    """
    out = df
    if mean:
        s = column_stats(df, mean).scalar()
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), s[f"{c}_avg"]) for c in mean})
    if forward:
        out = _forward_fill(out, forward, keys, order, hot_rows)
    fills = {c: F.coalesce(F.col(c), F.lit(0)) for c in [*forward, *zero]}
    return out.withColumns(fills)


def _forward_fill(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, hot_rows: int | None
) -> DataFrame:
    upto = Window.unboundedPreceding
    hot = None if hot_rows is None else find_hot(df, keys, order, hot_rows)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(upto, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    rows = with_slice(df, hot)
    # The newest known value of every slice, one row each, filled across slices.
    ends = rows.groupBy(*keys, SLICE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__in_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(upto, -1)
    ends = ends.withColumns(
        {f"__in_{c}": F.last(f"__in_{c}", ignorenulls=True).over(before) for c in columns}
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(order).rowsBetween(upto, 0)
    later = ends.where(F.col(SLICE) > 0)  # only hot keys have slices past the first
    filled = join_null_safe(rows, later, [*keys, SLICE]).withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__in_{c}"))
            for c in columns
        }
    )
    return filled.drop(SLICE, *[f"__in_{c}" for c in columns])
