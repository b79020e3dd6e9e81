"""Columns that look back over the packets of a key, on a stream, in blocks of packet numbers.

A key's share of a micro-batch can be the whole input, so it is cut into blocks of packet numbers. All rows of a block but
the first ``depth`` have what they look back on in the block itself. Those first rows and the last ones of each block, a few
dozen rows, go to the keyed state, which puts them behind each other and keeps the newest ``depth + 1`` for the next micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Packet numbers of a block: as many rows at most, if the numbers of a key are distinct.
BLOCK = 1 << 16

Compute = Callable[[pd.DataFrame], pd.DataFrame]


class BlockEnds(StatefulProcessor):
    """Keeps the newest rows of a key and emits the first rows of each block."""

    def __init__(self, keys: Sequence[str], read: dict[str, str], order: str, depth: int, names: Sequence[str], compute: Compute):
        self._keys, self._read, self._order, self._depth = list(keys), read, order, depth
        self._names, self._compute = list(names), compute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getListState("last", ", ".join(f"`{c}` {kind}" for c, kind in self._read.items()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values(self._order, kind="stable", ignore_index=True)
        read = list(self._read)
        kept = pd.DataFrame([tuple(r) for r in self._last.get()], columns=read)
        joined = pd.concat([_plain(kept, self._read), _plain(fresh[read], self._read)], ignore_index=True)
        last = joined.tail(self._depth + 1).astype(object)
        self._last.put([tuple(r) for r in last.where(last.notna(), None).itertuples(index=False)])
        # A gap that is none must not enter sums that are carried on from row to row.
        run = np.concatenate((np.zeros(len(kept), int), fresh["is_cut"].cumsum()))
        added = pd.concat([self._compute(part) for _, part in joined.groupby(run)]).iloc[len(kept) :].reset_index(drop=True)
        for position, name in enumerate(self._keys):
            fresh[name] = key[position]
        yield _with(fresh, added)[fresh["is_first"].to_numpy(bool)][self._names]

    def close(self) -> None:
        pass


def _plain(rows: pd.DataFrame, read: dict[str, str]) -> pd.DataFrame:
    """Columns of one kind whatever their nulls: whole numbers that may be missing, and doubles."""
    return rows.astype({c: "Int64" if kind == "long" else float for c, kind in read.items()})


def _with(rows: pd.DataFrame, added: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([rows.drop(columns=[c for c in added.columns if c in rows.columns]), added], axis=1)


def look_back(
    rows: DataFrame, keys: Sequence[str], order: str, read: dict[str, str], depth: int, compute: Compute, out: T.StructType
) -> DataFrame:
    """``compute`` over the packets of each key in ``order``, as they come by micro-batches; needs the RocksDB state store.

    ``compute`` takes the columns ``read`` (name to ``long`` or ``double``) of ordered rows and gives new columns; a row may
    look back on ``depth`` rows before it. ``out`` are the fields of the result, from ``rows`` or computed.
    """
    keys, names, given = list(keys), out.names, rows.columns
    place = F.floor(F.col(order) / BLOCK).alias("block")
    blocks = rows.withColumn("block", place).groupBy(*keys, "block")

    def inside(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order, kind="stable", ignore_index=True)
        if len(block) <= depth:
            return pd.DataFrame(columns=names)
        return _with(block, compute(_plain(block[list(read)], read))).iloc[depth:][names]

    def ends(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order, kind="stable", ignore_index=True).assign(is_first=False, is_cut=False)
        block.loc[: depth - 1, "is_first"] = True
        if len(block) > 2 * depth + 1:
            block.loc[len(block) - depth - 1, "is_cut"] = True
            block = pd.concat([block.iloc[:depth], block.iloc[-depth - 1 :]])
        return block[[*given, "is_first", "is_cut"]]

    marked = T.StructType([*rows.schema.fields, *[T.StructField(c, T.BooleanType()) for c in ("is_first", "is_cut")]])
    first = (
        blocks.applyInPandas(ends, marked)
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=BlockEnds(keys, read, order, depth, names, compute),
            outputStructType=out,
            outputMode="Append",
            timeMode="None",
        )
    )
    return blocks.applyInPandas(inside, out).unionByName(first)
