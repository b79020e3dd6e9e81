"""Helpers shared by the corpus operators: row batches, document keys, model files."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes of text that one step of a Python worker holds, however many rows a batch has.
STEP_BYTES = 8 << 20


def give_back() -> None:
    """Return what the allocators of this process hold but do not use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def released(step: _Step) -> _Step:
    """A step of mapInArrow that returns the memory it freed to the system when its task ends.

    Workers stay for later tasks; what their allocators keep would stand beside the executor's heap, also while only the JVM works.
    """

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def portions(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices with about ``most`` bytes of text; one longer text makes a slice of its own.

    ``text`` names the texts, or a column with their sizes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(text)
        sizes = pc.fill_null(own if pa.types.is_integer(own.type) else pc.binary_length(own), 0).to_numpy(zero_copy_only=False)
        cell = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.nonzero(np.diff(cell))[0] + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(begin, end - begin)


def bytes_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(batch.column(text).cast(pa.binary()), b"").to_pylist()


def text_key(text: str = "text") -> Column:
    """32 bits that tell texts of one doc_id apart."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others, whatever their names, can not clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def least_count(table: DataFrame, most: int) -> int:
    """Smallest count ``n`` for which no more than ``most`` rows have it or a larger one.

    Only the sizes of the counts are sorted and collected: no task gathers the largest rows of all others.
    """
    held, least = 0, 1 << 62
    for r in table.groupBy("n").count().orderBy(F.desc("n")).limit(most + 1).collect():
        held += r["count"]
        if held > most:
            break
        least = r.n
    return least
