"""Stored as-of totals: built once, extended by new days, read by the slices that a slate's frames touch.

A history's totals (``asof.History.totals``, sums that lose nothing) are kept in two keyed tables, cut into slices of a
month:

    daily     key, slice, day and the totals of that day
    carried   key, slice and the totals of all days before the slice, with the last such day

The total before a day is what is carried into its slice and the days of the slice before it. So a frame needs the slices of its
two ends, however long it is; slices between them are not read, and no history row is. New days are added to their slice,
and totals are carried from there on, in one job: for days at the end of the history into one slice, for a correction far
back into all that follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import History, _from_zero, day_number
from tidemark.sources.io import ContractError
from tidemark.sources.tables import KeyedTable


def slice_of(day: Column) -> Column:
    """Months since year 0 of a day number."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), day)
    return (F.year(date) * 12 + F.month(date)).cast("int")


class FeatureState:
    """Stored totals of one history; ``history`` gives the key, day, values and frames, and its rows the value types."""

    def __init__(self, spark: SparkSession, path: str, history: History):
        self.spark, self.history = spark, history
        self.daily = KeyedTable(spark, f"{path}/daily", ["_k", "_d", "_slice"], ["_slice"])
        self.carried = KeyedTable(spark, f"{path}/carried", ["_k", "_slice"], ["_slice"])
        self.fields = list(history.totals())

    def _last_slice(self) -> int | None:
        """The last slice into which totals are carried: one after the last that has days."""
        if self.carried.manifest() is None:
            return None
        return self.carried.read().agg(F.max("_slice")).first()[0]

    def extend(self, rows: DataFrame) -> None:
        """Add history rows. They hold all rows of their keys and days: a day that is stored already is replaced, key by
        key, so running it again changes nothing."""
        new = replace(self.history, rows=rows).daily().withColumn("_slice", slice_of(F.col("_d")))
        ends = new.agg(F.min("_slice").alias("first"), F.max("_slice").alias("last")).first()
        if ends["first"] is None:
            return
        self.daily.upsert(new)
        first, last = ends["first"], max(ends["last"] + 1, self._last_slice() or 0)
        days = self._slices(self.daily, range(first, last)).withColumnRenamed("_d", "_last")
        # what is carried into the first slice stands for all before it
        before = self._slices(self.carried, [first]).withColumn("_slice", F.lit(first - 1))
        sums = [F.max("_last").alias("_last"), *[F.sum(f).alias(f) for f in self.fields]]
        each = days.unionByName(before).groupBy("_k", "_slice").agg(*sums)
        order = Window.partitionBy("_k").orderBy("_slice")  # one row per key and slice
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        until = F.coalesce(F.lead("_slice").over(order), F.lit(last))
        running = each.select("_k", F.max("_last").over(upto).alias("_last"), *[F.sum(f).over(upto).alias(f) for f in self.fields], (F.col("_slice") + 1).alias("_from"), until.alias("_until"))
        later = running.withColumn("_slice", F.explode(F.sequence("_from", "_until"))).where(F.col("_slice") > first).drop("_from", "_until")
        self.carried.upsert(later)

    def _slices(self, table: KeyedTable, slices: Sequence[int]) -> DataFrame:
        """Rows of some slices: only their files are read."""
        if table.manifest() is None:  # no slice has been carried into yet
            source = self.daily.read().limit(0)
            return source.select("_k", F.col("_d").alias("_last"), *[F.col(f) for f in self.fields], "_slice")
        wanted = self.spark.createDataFrame([(s,) for s in slices], "_slice int")
        return table.read(wanted).where(F.col("_slice").isin(list(slices)))

    def read(self, requests: DataFrame, key: str, day: str) -> DataFrame:
        """``requests`` with the columns of ``asof`` for the history, from stored totals."""
        if (last := self._last_slice()) is None:
            raise ContractError("the state is empty")
        h = self.history
        borders = sorted({0, *h.starts()})
        asked = requests.select(F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("_asked"), F.col(key).alias("_k"), day_number(F.col(day)).alias("_at"))
        # requests that are alike share their totals
        looks = asked.where(F.col("_k").isNotNull() & F.col("_at").isNotNull()).select("_k", "_at").distinct()
        looks = looks.select("_k", "_at", F.explode(F.array(*[F.lit(n) for n in borders])).alias("_n")).withColumn("_border", F.col("_at") - F.col("_n"))
        looks = looks.withColumn("_slice", F.least(slice_of(F.col("_border")), F.lit(last)))
        slices = [r[0] for r in looks.select("_slice").distinct().collect()]  # a few for a day's slate, months of history at most
        # slices are compact in files and large in memory, so that they look small enough to broadcast: they are shuffled
        inside = looks.hint("merge").alias("l").join(self._slices(self.daily, slices).hint("merge").alias("t"), (F.col("l._k") == F.col("t._k")) & (F.col("l._slice") == F.col("t._slice")) & (F.col("t._d") < F.col("l._border")))
        parts = inside.select("l._k", "l._at", "l._n", F.col("t._d").alias("_last"), *[F.col(f"t.{f}") for f in self.fields])
        before = looks.hint("merge").join(self._slices(self.carried, slices).hint("merge"), ["_k", "_slice"]).select("_k", "_at", "_n", "_last", *[F.col(f) for f in self.fields])
        totals = parts.unionByName(before).groupBy("_k", "_at", "_n").agg(F.max("_last").alias("_last"), *[F.sum(f).alias(f) for f in self.fields])
        state = F.struct(F.col("_last").alias("day"), *self.fields)
        found = totals.groupBy("_k", "_at").agg(F.map_from_entries(F.collect_list(F.struct("_n", state.alias("s")))).alias("_found"))  # one per frame border
        joined = asked.join(found.hint("merge"), ["_k", "_at"], "left").select("_asked", *[F.col("_found")[n].alias(f"_at_{h.name}_{n}") for n in borders])
        return _from_zero(joined, [h]).selectExpr("_asked.*", *h.outputs(), f"date_add(DATE'1970-01-01', `_at_{h.name}_0`.day) AS prev_day")
