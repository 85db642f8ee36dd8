"""Walk-forward folds by row position, with a purge gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig


def positions(df: DataFrame, day: str, tie: str) -> DataFrame:
    """``df`` with ``position``, its place in the order (day, tie). Days are counted first and rows
    numbered within their day, so no task sorts the whole."""
    days = df.groupBy(F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(day).orderBy(tie)) - 1
    return df.join(days, F.col(day) == F.col("_day")).withColumn("position", F.col("_base") + within).drop("_day", "_base")


def fold_table(placed: DataFrame, day: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """``fold, lo, hi, cutoff, n_train``: validation positions [lo, hi), and training rows up to the
    cutoff day among positions before lo. Folds with too few training rows are left out."""
    n, f = F.col("n"), config.folds
    total = placed.agg(F.count(F.lit(1)).alias("n"))
    edges = total.select("n", F.explode(F.sequence(F.lit(1), F.lit(f))).alias("fold"))
    edges = edges.select("fold", F.floor(n * F.col("fold") / (f + 1)).alias("lo"), F.floor(n * (F.col("fold") + 1) / (f + 1)).alias("hi"))
    edges = F.broadcast(edges)  # one row per fold
    first = placed.join(edges, (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi"))).groupBy("fold", "lo", "hi").agg(F.min(day).alias("_first"))
    first = first.withColumn("cutoff", F.date_sub("_first", config.purge_days)).drop("_first")
    train = placed.join(F.broadcast(first), (F.col("position") < F.col("lo")) & (F.col(day) <= F.col("cutoff")))
    return train.groupBy("fold", "lo", "hi", "cutoff").agg(F.count(F.lit(1)).alias("n_train")).where(F.col("n_train") >= config.min_fold_rows)


def members(placed: DataFrame, folds: DataFrame, day: str) -> DataFrame:
    """``placed`` once per fold and part (``train`` or ``validation``) that it belongs to."""
    p = F.col("position")
    part = F.when((p >= F.col("lo")) & (p < F.col("hi")), "validation").when((p < F.col("lo")) & (F.col(day) <= F.col("cutoff")), "train")
    return placed.join(F.broadcast(folds)).withColumn("part", part).where("part IS NOT NULL").drop("lo", "hi", "cutoff", "n_train")
