"""Shannon entropy of byte strings, in bits.

Counting byte values needs a 256-slot histogram per row, which no built-in
expression gives at reasonable cost, so this is the one Arrow UDF of the package.
It works on the Arrow value buffer of a whole batch at a time: no per-row Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.constants import ENTROPY_CLASSES, ENTROPY_NORMAL, ENTROPY_TOP_CLASS

HEADER_BYTES = 7
_CHUNK_ROWS = 1024
_CHUNK_BYTES = 32 << 20
_NOISE = 1e-12


PACKET_ENTROPY = T.StructType(
    [
        T.StructField("payload_entropy", T.DoubleType()),
        T.StructField("header_entropy", T.DoubleType()),
        T.StructField("full_packet_entropy", T.DoubleType()),
    ]
)


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value bytes plus start and end of every row; a NULL row is empty."""
    array = array.cast(pa.large_binary())
    n = len(array)
    _, offsets, values = array.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=array.offset + n + 1)[array.offset :]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    start, end = bounds[:-1].copy(), bounds[1:].copy()
    if array.null_count:
        end[np.asarray(array.is_null())] = start[np.asarray(array.is_null())]
    return data, start, end


def _byte_entropy(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log2(n) - sum(c * log2(c)) / n over the byte counts c of each row."""
    out = np.zeros(len(start))
    size = np.maximum(end - start, 0)
    first = 0
    while first < len(start):
        # As many rows as fit the byte budget, at least one.
        filled = np.cumsum(size[first : first + _CHUNK_ROWS])
        last = first + max(1, int(np.searchsorted(filled, _CHUNK_BYTES)))
        n = size[first:last]
        total = int(n.sum())
        if total:
            slot = np.repeat(np.arange(len(n)) * 256, n)
            place = np.arange(total) + np.repeat(start[first:last] - (np.cumsum(n) - n), n)
            counts = np.bincount(slot + data[place], minlength=len(n) * 256)
            top = int(counts.max()) + 1
            if top <= len(counts):
                weight = _weighted(np.arange(top))[counts]
            else:
                weight = _weighted(counts)
            n1 = np.maximum(n, 1)
            value = np.log2(n1) - weight.reshape(len(n), 256).sum(axis=1) / n1
            out[first:last] = np.where(value < _NOISE, 0.0, value)
        first = last
    return out


def _weighted(counts: np.ndarray) -> np.ndarray:
    return counts * np.log2(np.maximum(counts, 1))


def _entropy_of(values: pa.Array) -> pa.Array:
    return pa.array(_byte_entropy(*_buffers(values)), type=pa.float64())


def _packet_entropy_of(raw: pa.Array, cut: pa.Array) -> pa.Array:
    data, start, end = _buffers(raw)
    skip = np.asarray(cut.fill_null(0), dtype=np.int64)
    body = _byte_entropy(data, np.minimum(start + skip, end), end)
    head_end = np.where(end - start >= HEADER_BYTES, start + HEADER_BYTES, start)
    head = _byte_entropy(data, start, head_end)
    full = _byte_entropy(data, start, end)
    return pa.StructArray.from_arrays(
        [pa.array(body), pa.array(head), pa.array(full)], names=PACKET_ENTROPY.fieldNames()
    )


def shannon_entropy(data: Column) -> Column:
    """Entropy of a binary or string column over its whole value; empty or NULL gives 0."""
    return F.arrow_udf(_entropy_of, T.DoubleType())(data.cast("binary"))


def packet_entropy(raw: Column, data_offset: int) -> Column:
    """Struct of payload, header (first seven bytes) and full-packet entropy in one Arrow trip."""
    return F.arrow_udf(_packet_entropy_of, PACKET_ENTROPY)(raw, F.lit(data_offset))


def register(spark: SparkSession) -> None:
    """Make ``shannon_entropy(binary)`` callable from SQL text."""
    spark.udf.register("shannon_entropy", F.arrow_udf(_entropy_of, T.DoubleType()))


def classify_entropy(entropy: Column) -> Column:
    out = F
    for upper, text in ENTROPY_CLASSES:
        out = out.when(entropy < upper, text)
    return out.otherwise(ENTROPY_TOP_CLASS)


def is_entropy_normal(
    entropy: Column, expected: tuple[float, float] = ENTROPY_NORMAL
) -> Column:
    return F.coalesce(entropy.between(*expected), F.lit(False))
