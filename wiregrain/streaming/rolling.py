"""Last-ten-packet features on a stream.

Row windows do not exist on streams. Blocks of a micro-batch are computed by themselves, and each key keeps its last eleven
packets as state for the first rows of a block. So memory is that of a block, whatever a key's share of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.operators.windows import BURST_MS, BURST_RUN, FRAME
from wiregrain.streaming.blocks import look_back

# Microseconds of our times are whole numbers as doubles too.
_READ = {"packet_number": "long"} | dict.fromkeys(["us", "packet_length", "payload_entropy", "function_code"], "double")


def _statistics(name: str) -> str:
    return ", ".join(f"{name}_{kind}_10 double" for kind in ("mean", "std", "min", "max"))


FEATURES = (
    "packet_number long, ts timestamp, packet_length double, payload_entropy double, function_code int, "
    "time_delta double, time_delta_ms double, inter_arrival_time double, "
    f"{_statistics('time_delta')}, time_delta_cv_10 double, {_statistics('packet_length')}, packet_length_cv_10 double, "
    f"{_statistics('payload_entropy')}, function_code_changes int, function_code_stability_10 double, "
    "burst_indicator int, burst_streak long, is_burst boolean, periodicity_score double"
)


def rolling_frame(rows: pd.DataFrame) -> pd.DataFrame:
    """Features of ordered rows of one key; a small helper on at most one block."""
    out = rows.copy()
    out["time_delta"] = rows["us"].diff() / 1e6
    out["time_delta_ms"] = out["time_delta"] * 1000
    out["inter_arrival_time"] = out["time_delta"].fillna(0.0)
    for name in ("time_delta", "packet_length", "payload_entropy"):
        frame = out[name].rolling(FRAME, min_periods=1)
        for kind in ("mean", "std", "min", "max"):
            out[f"{name}_{kind}_10"] = getattr(frame, kind)()
        if name != "payload_entropy":
            out[f"{name}_cv_10"] = (out[f"{name}_std_10"] / (out[f"{name}_mean_10"] + 1e-9)).fillna(0.0)
    changed = (rows["function_code"] != rows["function_code"].shift()).astype("int32")
    out["function_code_changes"] = changed
    out["function_code_stability_10"] = 1 - changed.rolling(FRAME, min_periods=1).mean()
    out["burst_indicator"] = (out["time_delta_ms"] < 5).astype("int32")
    fast = (out["time_delta_ms"] < BURST_MS).astype("int64")
    out["burst_streak"] = fast.rolling(FRAME, min_periods=1).sum().astype("int64")
    out["is_burst"] = out["burst_streak"] >= BURST_RUN
    out["periodicity_score"] = 1 - out["time_delta_cv_10"]
    return out


def _features(rows: pd.DataFrame) -> pd.DataFrame:
    out = rolling_frame(rows)
    return out.assign(function_code=out["function_code"].astype("Int32"))


def rolling_stream(packets: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Rolling features per key of a packet stream (needs the RocksDB state store).

    ``carry`` names columns that go along unchanged. Streams without payload entropy get NULL for its features.
    """
    keys, carry = list(keys), list(carry)
    entropy = F.col("payload_entropy") if "payload_entropy" in packets.columns else F.lit(None)
    rows = packets.select(
        *keys,
        "packet_number",
        "ts",
        F.unix_micros("ts").cast("double").alias("us"),
        F.col("packet_length").cast("double"),
        entropy.cast("double").alias("payload_entropy"),
        "function_code",
        *carry,
    )
    ddl = lambda names: "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    out = T.StructType.fromDDL(f"{ddl(keys)[2:]}, {FEATURES}{ddl(carry)}")
    return look_back(rows, keys, "packet_number", _READ, FRAME, _features, out)
