"""Orders over whole tables in two levels: ranges of values, and rows within a range.

Cuts come from a quantile sketch, so ranges hold about as many rows each and no task sorts the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE_ROWS = 1 << 20


def in_ranges(df: DataFrame, column: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_r``, the number of its range of ``column``; null values are in the first."""
    n = -(-df.count() // rows)
    if n <= 1:
        return df.withColumn("_r", F.lit(0))
    marks = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(column, marks, max(10_000, 20 * n)).alias("c")).first()["c"]  # one number per range
    place = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(column)))
    return df.withColumn("_r", F.when(F.col(column).isNotNull(), place).otherwise(0))


def group_ranges(counts: DataFrame, keys: Sequence[str], value: str, rows: int = RANGE_ROWS) -> DataFrame | None:
    """``counts`` with ``_r``, the number of its range of ``value`` within its group, where a group has more than ``rows``
    rows; None if none has. Cuts are numbers of the large groups only, of which there are few, and are broadcast."""
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    largest = sizes.agg(F.max("_m")).first()[0] or 0
    if largest <= rows:
        return None
    n = -(-largest // rows)
    named = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    on = lambda df: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.lit(True))
    large = sizes.where(F.col("_m") > rows).select(*named)
    of_large = counts.join(F.broadcast(large), on(counts))
    cuts = of_large.groupBy(*large.columns).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 20 * n)))).alias("_cuts"))
    joined = counts.join(F.broadcast(cuts), on(counts), "left")
    place = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return joined.withColumn("_r", F.when(F.col("_cuts").isNotNull() & F.col(value).isNotNull(), place).otherwise(0)).drop("_cuts", *large.columns)


def _middle(placed: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Median per group from values ``_v`` with the rows up to each (``_upto``) and of the group (``_all``)."""
    low = F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("_v")))
    high = F.min(F.when(F.col("_upto") * 2 > F.col("_all"), F.col("_v")))
    return placed.groupBy(*keys).agg(((low.cast("double") + high) / 2).alias(name))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", rows: int = RANGE_ROWS) -> DataFrame:
    """``keys`` and the median of each group's values; nulls are left out, a group of nulls has none. With no keys one row.

    Equal values are counted first, so a value that a third of all rows have is one row. Groups of more than ``rows`` distinct
    values are cut into ranges, where rows are counted within a range and added to those of the ranges before it, so no
    task holds a whole group.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))  # 0 for null
    if not keys:
        counts = counts.withColumn("_one", F.lit(0))
    group = list(keys) or ["_one"]
    cut = group_ranges(counts, group, "_v", rows)
    upto = lambda order, *parts: Window.partitionBy(*group, *parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    order = F.col("_v").asc_nulls_last()
    if cut is None:
        whole = Window.partitionBy(*group)
        return _middle(counts.withColumns({"_upto": F.sum("_n").over(upto(order)), "_all": F.sum("_n").over(whole)}), keys, name)
    before = upto(F.col("_r")).rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy(*group, "_r").agg(F.sum("_n").alias("_n"))  # one row per range
    bases = bases.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(group)], F.col("_r").alias("_br"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*group)).alias("_all"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(group)], F.col("_r") == F.col("_br"))
    placed = cut.withColumn("_in", F.sum("_n").over(upto(order, "_r"))).join(bases, on)
    return _middle(placed.withColumn("_upto", F.col("_base") + F.col("_in")), keys, name)


def with_medians(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], values: dict[str, str], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` grouped by ``keys`` with ``aggs`` and the medians of columns (``values``: name of the result to column). Where every
    group is small enough for one task it is one aggregate; else medians are found in ranges and joined."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).agg(F.max("_m")).first()[0] or 0
    if largest <= rows:
        return df.groupBy(*keys).agg(*aggs, *[F.median(c).alias(n) for n, c in values.items()])
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    for n, c in values.items():
        medians = exact_medians(df, keys, c, n, rows).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], n)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
        out = out.join(medians, on).drop(*[f"_k{i}" for i in range(len(keys))])
    return out


def exact_median(df: DataFrame, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """One row ``median`` of all rows' values, null values left out."""
    return exact_medians(df, [], value, "median", rows)
