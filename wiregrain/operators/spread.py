"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here a key
with more than ``hot_rows`` rows is cut into slices of its (integer) order
column, every slice is a window partition of its own, and the few rows a slice
needs from before its start travel along as marked extra rows that are dropped
afterwards. Without a hot key the plain window runs.

A key is cut evenly over its range; slices that are still too large (a flood within a quiet
capture, a flood within that flood) are cut over their own range again, until none is left or
the slices are as narrow as the order column's values. The tables of hot keys and large slices have at most
``total rows / hot_rows`` rows; Spark chooses how to join them by their size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wiregrain.session import settle

HOT_ROWS = 2_000_000

SLICE = "__slice"
_CARRIED = "__carried"
# A slice number has the cuts of all levels as its digits.
_CUTS = 1 << 15
_LEVELS = 4


@dataclass(frozen=True)
class HotKeys:
    """Where to cut the keys above the limit, level by level."""

    keys: list[str]
    order: str
    levels: list[DataFrame]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a NULL key is a key like any other; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def find_hot(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int) -> HotKeys | None:
    """Cuts of all keys with more than ``hot_rows`` rows, None when there is no such key.

    Reads only the key and order columns; counts are combined before any shuffle.
    """
    keys = list(keys)
    rows, by = df.select(*keys, order), keys
    levels: list[DataFrame] = []
    for level in range(_LEVELS):
        cuts = _cuts(rows, by, order, hot_rows, level)
        if cuts.isEmpty():
            break
        levels.append(settle(cuts))
        rows = _cut(rows, by, order, levels[-1], level, "inner")
        by = [*by, f"__cut{level}"]
    return HotKeys(keys, order, levels) if levels else None


def _cuts(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int, level: int) -> DataFrame:
    """Start and slice width of the groups above the limit; below the first level as fine as the digits allow,
    which leaves dozens of rows in a slice when the limit is millions."""
    spans = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")
    )
    pieces = F.least(F.ceil(F.col("n") / hot_rows), F.lit(_CUTS - 1)) if level == 0 else F.lit(_CUTS - 1)
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / pieces), F.lit(1))
    # A single value of the order column can not be cut.
    return spans.where((F.col("n") > hot_rows) & (F.col("hi") > F.col("lo"))).select(
        *keys, F.col("lo").alias(f"__lo{level}"), width.cast("long").alias(f"__width{level}")
    )


def _cut(
    df: DataFrame, keys: Sequence[str], order: str, cuts: DataFrame, level: int, how: str
) -> DataFrame:
    place = F.expr(f"cast((`{order}` - __lo{level}) div __width{level} as long)")
    return (
        join_null_safe(df, cuts, keys, how)
        .withColumn(f"__cut{level}", F.coalesce(place, F.lit(0).cast("long")))
        .drop(f"__lo{level}", f"__width{level}")
    )


def with_slice(df: DataFrame, hot: HotKeys | None, only_hot: bool = False) -> DataFrame:
    """Add the slice number: 0 for ordinary keys, rising with the order column for hot ones."""
    if hot is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    out, by = df, hot.keys
    number = F.lit(0).cast("long")
    for level in range(_LEVELS):
        if level < len(hot.levels):
            out = _cut(out, by, hot.order, hot.levels[level], level, "inner" if only_hot and not level else "left")
            by = [*by, f"__cut{level}"]
            number = number * _CUTS + F.col(f"__cut{level}")
        else:
            number = number * _CUTS
    return out.withColumn(SLICE, number).drop(*[f"__cut{level}" for level in range(len(hot.levels))])


def ordered(
    df: DataFrame,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    carry: Sequence[str] = (),
    depth: int = 10,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Run ``compute(df, window)`` over the rows of each key in order.

    ``compute`` may look back at most ``depth`` rows in total (a ten-row frame
    over a one-row lag is ten) and reads only ``carry`` plus the key and order columns.
    ``order`` is an integer column; ``ties`` breaks equal values. ``hot_rows=None``
    says that no key is large and skips the search for hot ones. ``df`` is read for the
    key counts, for the carried rows of hot keys and for the result, so settle a costly one first.
    """
    sort = [F.col(c) for c in (order, *ties)]
    hot = None if hot_rows is None else find_hot(df, keys, order, hot_rows)
    if hot is None:
        return compute(df, Window.partitionBy(*keys).orderBy(*sort))

    rows = with_slice(df, hot).withColumn(_CARRIED, F.lit(False))

    fields = list(dict.fromkeys([order, *ties, *carry]))
    fields = [c for c in fields if c not in keys]
    tail_order = Window.partitionBy(*keys, SLICE).orderBy(*[c.desc() for c in sort])
    tails = (
        with_slice(df.select(*keys, *fields), hot, only_hot=True)
        .withColumn("__back", F.row_number().over(tail_order))
        .where(F.col("__back") <= depth)
        .groupBy(*keys, SLICE)
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("__back"), *fields))).alias("__tail"))
    )
    # Every slice present has at least one row, so `depth` slices hold at least `depth` rows.
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-depth, -1)
    earlier = F.flatten(F.collect_list("__tail").over(before))
    last = F.when(F.size("__all") > depth, F.slice("__all", -depth, depth)).otherwise(F.col("__all"))
    carried = (
        tails.withColumn("__all", earlier)
        .select(*keys, SLICE, F.explode(last).alias("__row"))
        .select(*keys, SLICE, *[F.col(f"__row.{c}").alias(c) for c in fields])
        .withColumn(_CARRIED, F.lit(True))
    )
    both = rows.unionByName(carried, allowMissingColumns=True)
    done = compute(both, Window.partitionBy(*keys, SLICE).orderBy(*sort))
    return done.where(~F.col(_CARRIED)).drop(_CARRIED, SLICE)


def dense_index(
    df: DataFrame,
    name: str,
    *,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based position of each row within its key: slice counts first, then a local number."""
    hot = find_hot(df, keys, order, hot_rows)
    if hot is None:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))
        return df.withColumn(name, number.cast("long"))
    rows = with_slice(df, hot)
    counts = rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # Only slices after the first need an offset, and only hot keys have those.
    offsets = counts.withColumn("__before", F.sum("__n").over(upto)).where(F.col(SLICE) > 0)
    offsets = offsets.select(*keys, SLICE, "__before")
    local = Window.partitionBy(*keys, SLICE).orderBy(order, *ties)
    numbered = rows.withColumn("__local", F.row_number().over(local))
    return (
        join_null_safe(numbered, offsets, [*keys, SLICE])
        .withColumn(name, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long"))
        .drop("__local", "__before", SLICE)
    )


def running_max(
    df: DataFrame,
    column: str,
    name: str,
    *,
    keys: Sequence[str],
    order: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Largest ``column`` so far within the key, rows of equal order included."""
    upto = Window.unboundedPreceding
    hot = find_hot(df, keys, order, hot_rows)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(order).rangeBetween(upto, Window.currentRow)
        return df.withColumn(name, F.max(column).over(whole))
    rows = with_slice(df, hot)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(upto, -1)
    tops = rows.groupBy(*keys, SLICE).agg(F.max(column).alias("__top"))
    tops = tops.withColumn("__top", F.max("__top").over(before)).where(F.col(SLICE) > 0)
    tops = tops.select(*keys, SLICE, "__top")
    inside = Window.partitionBy(*keys, SLICE).orderBy(order).rangeBetween(upto, Window.currentRow)
    topped = rows.withColumn(name, F.max(column).over(inside))
    return (
        join_null_safe(topped, tops, [*keys, SLICE]).withColumn(name, F.greatest(name, "__top")).drop("__top", SLICE)
    )


def running_sum(
    df: DataFrame, sums: dict[str, str], *, keys: Sequence[str], bucket: str, order: Sequence[Column]
) -> DataFrame:
    """Cumulative sums over an order that is already cut into ``bucket`` numbers.

    Bucket totals are added up first (one row per bucket), then each bucket runs
    its own window, so no task sees more than one bucket of a key.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    for c in sums:
        totals = totals.withColumn(f"__t_{c}", F.coalesce(F.sum(f"__t_{c}").over(upto), F.lit(0)))
    inside = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = join_null_safe(df, totals, [*keys, bucket], "inner")
    out = out.withColumns({new: F.sum(c).over(inside) + F.col(f"__t_{c}") for c, new in sums.items()})
    return out.drop(*[f"__t_{c}" for c in sums])
