"""Time since the packet before, on a stream: the last two times of state for each key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.streaming.blocks import look_back


def _gaps(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"inter_arrival_time": (rows["time_us"].diff() / 1e6).fillna(0.0)})


def gap_stream(packets: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """``inter_arrival_time`` in seconds next to all columns, as ``inter_arrival`` gives it; needs the RocksDB state store."""
    out = T.StructType([*packets.schema.fields, T.StructField("inter_arrival_time", T.DoubleType())])
    rows = packets.withColumn("time_us", F.unix_micros("ts").cast("double"))  # no leading underscores
    return look_back(rows, keys, "packet_number", {"time_us": "double"}, 1, _gaps, out)
