"""Requests and responses on a stream, from keyed state and event-time timers.

The keys are dealt into buckets, and a bucket is one group of state: its open requests and the responses that may still
answer one, as Arrow blocks. One timer stands for the oldest open request of a bucket; when the watermark has passed it, all
requests that are due leave the state at once, with their answer or without, and so do the responses that no open and no
coming request can meet. So the state holds what lies within limit and allowed delay, a bucket is sorted once for each
micro-batch, and no request meets every response.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_SECOND = 1_000_000
#: Groups of state. More make smaller blocks, fewer make fewer calls.
BUCKETS = 1024


def _second(us: np.ndarray) -> np.ndarray:
    """The next whole second, in microseconds."""
    return -(-us // _SECOND) * _SECOND


class OpenRequests(StatefulProcessor):
    """Blocks of messages (key columns as text, us, number, asks). Timers stand at whole seconds."""

    def __init__(self, keys: int, timeout_us: int):
        self._keys, self._timeout = [f"k{i}" for i in range(keys)], timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._blocks = handle.getListState("messages", "block binary")

    def _packed(self, rows: pd.DataFrame) -> bytes:
        columns = {k: pa.array(rows[k], pa.string(), from_pandas=True) for k in self._keys}
        kinds = {"us": pa.int64(), "number": pa.int64(), "asks": pa.bool_()}
        batch = pa.record_batch(columns | {c: pa.array(rows[c], kind) for c, kind in kinds.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def _due(self, rows: pd.DataFrame) -> np.ndarray:
        """When a request is due, and when no coming request can be as old as a response."""
        return _second(rows["us"].to_numpy() + self._timeout * rows["asks"].to_numpy())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            self._blocks.appendValue((self._packed(chunk),))
            due = int(self._due(chunk).min())
            first = due if first is None else min(first, due)
        if first is not None:
            self._handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [pa.ipc.open_stream(block).read_all() for (block,) in self._blocks.get()]
        if not blocks:
            return  # an earlier timer has done it
        rows = pa.concat_tables(blocks).to_pandas()
        rows["of"] = rows.groupby(self._keys, dropna=False, sort=False).ngroup()
        # At equal times requests stand before responses, so the next response of a key is the answer.
        rows = rows.assign(answers=~rows["asks"]).sort_values(["of", "us", "answers", "number"], ignore_index=True)
        of, us, asks = (rows[c].to_numpy() for c in ("of", "us", "asks"))
        open_ = asks & (self._due(rows) >= now)
        # Responses are kept for open requests that are not younger, and for those still to come.
        oldest = np.full(of[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(oldest, of[open_], us[open_])
        kept = rows[open_ | (~asks & ((us >= now) | (us >= oldest[of])))]
        closed = asks & ~open_
        if len(kept) < len(rows):
            columns = [*self._keys, "us", "number", "asks"]
            self._blocks.put([(self._packed(kept[columns]),)]) if len(kept) else self._blocks.clear()
        if len(kept):
            due = self._due(kept)
            waiting = due[kept["asks"].to_numpy()]
            self._handle.registerTimer(int(max(waiting.min() if len(waiting) else due.max(), now // _SECOND * _SECOND)) // 1000)
        if not closed.any():
            return
        at = np.where(asks, len(rows), np.arange(len(rows)))
        at = np.minimum.accumulate(at[::-1])[::-1][closed]
        reply = np.minimum(at, len(rows) - 1)
        wait = us[reply] - us[closed]
        found = (at < len(rows)) & (of[reply] == of[closed]) & (wait <= self._timeout)
        asked = rows[closed].reset_index(drop=True)
        out = asked[self._keys].assign(
            request_number=asked["number"],
            response_number=pd.Series(rows["number"].to_numpy()[reply], dtype="Int64").where(found),
            response_delay_ms=pd.Series(wait / 1000).where(found),
        )
        yield out

    def close(self) -> None:
        pass


def _text(name: str, kind: T.DataType) -> Column:
    return F.base64(name) if isinstance(kind, T.BinaryType) else F.col(f"`{name}`").cast("string")


def _typed(name: str, kind: T.DataType) -> Column:
    return F.unbase64(name) if isinstance(kind, T.BinaryType) else F.col(name).cast(kind)


def pair_stream(
    messages: DataFrame, keys: Sequence[str], timeout: str = "10 seconds", late: str = "2 minutes"
) -> DataFrame:
    """Each request with its earliest response at or after it within the timeout, by time, whatever the packet numbers say.

    A request is due at the whole second at or after its time plus the timeout, and comes out, with a response or as an orphan,
    once the watermark lies behind that. Needs the RocksDB state store. Messages without time or side are left out.
    """
    kinds = {k: messages.schema[k].dataType for k in keys}
    limit = messages.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + interval {timeout})").first()[0]
    texts = [_text(k, kind).alias(f"k{i}") for i, (k, kind) in enumerate(kinds.items())]
    rows = (
        messages.where("ts IS NOT NULL AND is_request IS NOT NULL")
        .withWatermark("ts", late)
        .select(
            F.pmod(F.xxhash64(*texts), F.lit(BUCKETS)).alias("bucket"),
            "ts",
            F.unix_micros("ts").alias("us"),
            F.col("packet_number").cast("long").alias("number"),
            F.col("is_request").alias("asks"),
            *texts,
        )
    )
    fields = "".join(f"k{i} string, " for i in range(len(kinds)))
    out = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OpenRequests(len(kinds), limit),
        outputStructType=T.StructType.fromDDL(
            f"{fields}request_number long, response_number long, response_delay_ms double"
        ),
        outputMode="Append",
        timeMode="EventTime",
    )
    back = [_typed(f"k{i}", kind).alias(k) for i, (k, kind) in enumerate(kinds.items())]
    return out.select(*back, "request_number", "response_number", "response_delay_ms")
