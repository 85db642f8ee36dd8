"""Latest rows per key, first rows, and trailing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import RANGE_ROWS, in_ranges


def latest(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str] = (), cutoff: Column | None = None) -> DataFrame:
    """The row with the largest ``at`` per key, by falling ``ties`` where several have it.

    ``cutoff``: rows for which it is not true are left out first (for instance captured before the
    start). Catalyst turns the filter on the row number into a limit per group before the shuffle.
    """
    rows = df if cutoff is None else df.where(cutoff)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), *[F.desc_nulls_last(t) for t in ties])
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def latest_of(df: DataFrame, key_col: str, key, at: str, ties: Sequence[str] = ()) -> DataFrame:
    """The latest row of one key."""
    return df.where(F.col(key_col) == F.lit(key)).orderBy(F.desc(at), *[F.desc(t) for t in ties]).limit(1)


def trailing(df: DataFrame, at: str, ties: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows by time."""
    return df.orderBy(F.desc(at), *[F.desc(t) for t in ties]).limit(n)


def since(at: str, now: Column, days: int) -> Column:
    """Within the ``days`` before ``now``."""
    return F.col(at) >= now - F.make_interval(days=F.lit(days))


def monotonic(df: DataFrame, position: str, day: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row: ``n_back``, how many rows have an earlier day than the row before them. Rows are compared
    within ranges of positions, and the ranges by their first and last rows."""
    rows = in_ranges(df.select(F.col(position).alias("_p"), F.col(day).alias("_d")), "_p", range_rows)
    within = rows.select("_r", "_p", "_d", F.lag("_d").over(Window.partitionBy("_r").orderBy("_p")).alias("_before"))
    ends = within.groupBy("_r").agg(
        F.count_if(F.col("_d") < F.col("_before")).alias("_n"),
        F.min(F.struct("_p", "_d"))["_d"].alias("_first"), F.max(F.struct("_p", "_d"))["_d"].alias("_last"),
    )
    over = Window.partitionBy(F.lit(0)).orderBy("_r")  # one row per range
    ends = ends.select("_n", (F.col("_first") < F.lag("_last").over(over)).alias("_back"))
    return ends.agg((F.coalesce(F.sum("_n"), F.lit(0)) + F.count_if("_back")).alias("n_back"))
