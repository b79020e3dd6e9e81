"""Exact quantiles (linear interpolation) by aggregation passes.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, which a hot group does not survive. Here a mergeable sketch brackets
each wanted rank, histograms inside the bracket narrow it down, again and again until the
bin that holds the rank is small or one value, however the values lie, and only the
rows of these bins are sorted. The sketch only steers
where to look: the ranks are exact counts, and rows outside the bracket form
bins of their own, so the answer is exact however good the sketch is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.operators.spread import join_null_safe
from wiregrain.session import settle

_SKETCH_K = 4096
_MARGIN = 0.003
_BINS = 4096
_MERGE_WAYS = 64
#: Rows of a bin that one task may sort.
BIN_ROWS = 1_000_000


def _melt(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in values)
    long = df.select(*keys, F.expr(f"stack({len(values)}, {pairs}) as (feature, x)"))
    return long.where(F.col("x").isNotNull())


def _brackets(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    # Two merge levels, so that no reducer receives one sketch from every map task.
    ways = df.withColumn("__way", F.spark_partition_id() % _MERGE_WAYS)
    parts = ways.groupBy(*keys, "__way").agg(
        *[F.kll_sketch_agg_double(c, F.lit(_SKETCH_K)).alias(f"s_{c}") for c in values],
        *[F.count(c).alias(f"n_{c}") for c in values],
    )
    whole = parts.groupBy(*keys).agg(
        *[F.kll_merge_agg_double(f"s_{c}").alias(f"s_{c}") for c in values],
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in values],
    )
    pairs = ", ".join(f"'{c}', s_{c}, n_{c}" for c in values)
    sketch = F.col("sketch")
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"),
                F.kll_sketch_get_quantile_double(sketch, F.lit(max(p - _MARGIN, 0.0))).alias("lo"),
                F.kll_sketch_get_quantile_double(sketch, F.lit(min(p + _MARGIN, 1.0))).alias("hi"),
            )
            for p in probs
        ]
    )
    return (
        whole.select(*keys, F.expr(f"stack({len(values)}, {pairs}) as (feature, sketch, n)"))
        .where(F.col("n") > 0)
        .select(*keys, "feature", "n", F.inline(wanted))
        .withColumn("rank", F.col("prob") * (F.col("n") - 1))
    )


def _bin() -> Column:
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    inside = F.least(F.floor((x - lo) / (hi - lo) * _BINS), F.lit(_BINS - 1)).cast("int")
    return (
        F.when(x < lo, -1).when(x > hi, _BINS).when(hi <= lo, 0).otherwise(inside)
    )


def _narrowed(rows: DataFrame, brackets: DataFrame, per: list[str], bin_rows: int) -> DataFrame:
    """The bins that hold the wanted ranks: ``(per..., prob, slot, rank, lo, hi, base, c)`` with ``c`` values from ``lo``
    to ``hi`` and ``base`` values below. A bin has at most ``bin_rows`` values or a single one.

    Bounds are the smallest and largest value found in a bin, so each round parts at least these two.
    """
    at = [*per, "prob", "slot"]
    first = [F.lit("").alias("slot"), "rank", "lo", "hi", F.lit(0).cast("long").alias("base")]
    todo, done = brackets.select(*per, "prob", *first), []
    while True:
        near = join_null_safe(rows, todo, per, "inner")
        if done:
            near = near.where(F.col("x").between(F.col("lo"), F.col("hi")))
        counts = near.withColumn("bin", _bin()).groupBy(*at, "bin").agg(
            F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        ends = counts.withColumn("end", F.sum("c").over(Window.partitionBy(*at).orderBy("bin")))
        end = F.col("base") + F.col("end")
        placed = join_null_safe(ends, todo.select(*at, "rank", "base"), at, "inner")
        held = (end - F.col("c") <= F.ceil("rank")) & (end > F.floor("rank"))
        slot = F.concat("slot", F.lit("/"), F.col("bin").cast("string")).alias("slot")
        found = settle(
            placed.where(held).select(*per, "prob", slot, "rank", "lo", "hi", (end - F.col("c")).alias("base"), "c")
        )
        # A range that is no finite number can not be cut into equal parts.
        cut = (F.col("c") > bin_rows) & (F.col("lo") < F.col("hi")) & (F.col("hi") - F.col("lo") < float("inf"))
        done.append(found.where(~cut))
        todo = found.where(cut).drop("c")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)


def exact_quantiles(
    df: DataFrame,
    values: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    stored: bool = False,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Rows ``(keys..., feature, prob, value)``; groups without a value give no row.

    The passes read ``df`` three times, and once more for each round of narrowing. Say ``stored`` when it is a stored
    table; otherwise the few columns needed are settled once, so that windows and joins before this run once.
    """
    keys = list(keys)
    per = [*keys, "feature"]
    df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    df = df if stored else settle(df)
    rows = _melt(df, keys, values)
    bins = _narrowed(rows, settle(_brackets(df, keys, values, probs)), per, bin_rows)

    picked = (
        join_null_safe(rows, bins.drop("c"), per, "inner")
        .where(F.col("x").between(F.col("lo"), F.col("hi")))
        .groupBy(*per, "prob", "slot", "rank", "base", "x")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    inside = Window.partitionBy(*per, "prob", "slot").orderBy("x")
    placed = picked.withColumn("end", F.col("base") + F.sum("c").over(inside))
    placed = placed.withColumn("start", F.col("end") - F.col("c"))

    def holding(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (F.col("end") > rank), F.col("x")))

    low, high = F.floor("rank"), F.ceil("rank")
    return (
        placed.groupBy(*per, "prob", "rank")
        .agg(holding(low).alias("a"), holding(high).alias("b"))
        .select(
            *per, "prob", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - low)).alias("value")
        )
    )


def quantile_table(
    df: DataFrame,
    wanted: dict[str, tuple[str, float]],
    keys: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """One row per key with a named column per ``(feature, prob)``; one row in total without keys."""
    values = sorted({feature for feature, _ in wanted.values()})
    probs = sorted({prob for _, prob in wanted.values()})
    long = exact_quantiles(df, values, probs, keys, stored)
    picks = [
        F.max(F.when((F.col("feature") == f) & (F.col("prob") == p), F.col("value"))).alias(name)
        for name, (f, p) in wanted.items()
    ]
    return long.groupBy(*keys).agg(*picks)
