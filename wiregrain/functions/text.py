"""Small scalar helpers: addresses, group keys, register numbers, ISO times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiregrain.constants import LABELS, REGISTER_BASE


def last_octet(ip: Column) -> Column:
    """Last dotted part as an integer, NULL when it is not one."""
    return F.substring_index(ip, ".", -1).try_cast("int")


def group_name(*keys: str) -> Column:
    return F.concat_ws("_", *[F.col(k).cast("string") for k in keys])


def register_offset(register: Column) -> Column:
    return register - REGISTER_BASE


def offset_register(offset: Column) -> Column:
    return offset + REGISTER_BASE


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def label_number(label: Column) -> Column:
    """Number of a packet label, NULL for an unknown one."""
    out = F
    for name, number in LABELS.items():
        out = out.when(label == name, number)
    return out.otherwise(F.lit(None).cast("int"))


def label_name(number: Column) -> Column:
    out = F
    for name, value in LABELS.items():
        out = out.when(number == value, name)
    return out.otherwise(F.lit(None).cast("string"))


def short_label(profile: Column) -> Column:
    """``P1_APT`` to ``P1``; ``N`` stays ``N``."""
    return F.substring_index(profile, "_", 1)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6
