"""Integers out of binary columns, as plain expressions (offsets count from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(data: Column, offset: int | Column) -> Column:
    return _unsigned(data, offset, 1)


def be16(data: Column, offset: int | Column) -> Column:
    return _unsigned(data, offset, 2)


def le16(data: Column, offset: int | Column) -> Column:
    return u8(data, offset) + u8(data, offset + 1) * 256


def head64(data: Column) -> Column:
    """The first eight bytes as one big-endian long; missing bytes are 0."""
    return F.conv(F.rpad(F.hex(F.substring(data, 1, 8)), 16, "0"), 16, -10).cast("long")


def field(head: Column, offset: int, width: int) -> Column:
    """Big-endian integer of ``width`` bytes out of ``head64``."""
    shifted = F.shiftrightunsigned(head, 64 - 8 * (offset + width))
    return shifted.bitwiseAND(F.lit((1 << 8 * width) - 1)).cast("int")


def rest(data: Column, offset: int | Column) -> Column:
    """Bytes from ``offset`` to the end."""
    return F.substring(data, _start(offset), F.length(data))


def put(value: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative integer, the inverse of the readers."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def _unsigned(data: Column, offset: int | Column, width: int) -> Column:
    return F.conv(F.hex(F.substring(data, _start(offset), width)), 16, 10).cast("int")


def _start(offset: int | Column) -> Column:
    return F.lit(offset + 1) if isinstance(offset, int) else (offset + 1).cast("int")
