"""Scores of probability forecasts, calibration, drift and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.exprs import brier, clip, log_loss
from tidemark.operators.latest import since, trailing
from tidemark.operators.ranges import exact_median, with_medians


def summary(df: DataFrame, p: str, y: str, by: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Count, mean Brier score and log-loss, and mean and median of ``value``, per group."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(brier(F.col(p), F.col(y))).alias("brier"), F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss")]
    if value is None:
        return df.groupBy(*by).agg(*aggs)
    aggs.append(F.avg(value).alias(f"mean_{value}"))
    if by:
        return with_medians(df, by, aggs, {f"median_{value}": value})
    return df.agg(*aggs).join(F.broadcast(exact_median(df, value).withColumnRenamed("median", f"median_{value}")))  # one row each


def calibration(df: DataFrame, p: str, y: str) -> DataFrame:
    """Mean forecast and event rate per tenth; 1.0 is a bin of its own."""
    return df.groupBy((F.floor(F.col(p) * 10) / 10).alias("bin")).agg(
        F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def drift_alerts(df: DataFrame, p: str, y: str, at: str, ties: Sequence[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """Bins of the trailing rows whose forecast and rate differ too much; none below the least rows."""
    tail = trailing(df, at, ties, config.drift_rows)
    bins = tail.where(F.col(p) < 1).groupBy(F.floor(F.col(p) * 10).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate")
    )
    total = tail.agg(F.count(F.lit(1)).alias("_total"))
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    hit = (F.col("_total") >= config.drift_min_rows) & (F.col("n") >= config.drift_bin_rows) & (gap > config.drift_gap)
    return bins.join(F.broadcast(total)).where(hit).select("bin", "n", "mean_p", "rate", gap.alias("gap"))


def mean_alert(df: DataFrame, value: str, at: str, now: Column, days: int = 30, least: int = 50) -> DataFrame:
    """One row if the mean of ``value`` over the period is negative on enough rows."""
    got = df.where(since(at, now, days)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return got.where((F.col("n") >= least) & (F.col("mean") < 0))


def evidence(df: DataFrame, value: str, at: str, now: Column, days: int = 90, rows: int = 500) -> DataFrame:
    """One row: days since the first grade, graded rows, mean value, and whether the evidence suffices."""
    got = df.agg(
        F.datediff(now.cast("date"), F.min(at).cast("date")).alias("days"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )
    met = (F.col("days") >= days) & (F.col("n") >= rows) & (F.col("mean") > 0)
    return got.withColumn("met", F.coalesce(met, F.lit(False)))


def group_rates(df: DataFrame, key: str, y: str, least: int = DEFAULT.min_group_rows) -> DataFrame:
    """Base rate of each group with enough rows; a null key is no group."""
    got = df.where(F.col(key).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return got.where(F.col("n") >= least)


def roc_auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """One row ``auc`` by the rank sum, ties at their mean rank. Scores are counted before they are
    ranked, and ranked in two levels, so no task sorts all rows."""
    by = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")
    )
    by = by.withColumn("bin", F.floor(F.col("s") * 1000))
    bins = by.groupBy("bin").agg(F.sum("n").alias("bn")).withColumn(
        "base", F.coalesce(F.sum("bn").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    upto = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.join(bins, "bin").withColumn("rank", F.col("base") + F.coalesce(F.sum("n").over(upto), F.lit(0)) + (F.col("n") + 1) / 2)
    got = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum("n").alias("nt"))
    pairs = F.col("np").cast("double") * (F.col("nt") - F.col("np"))
    return got.select(((F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def baseline(df: DataFrame, y: str, epsilon: float = DEFAULT.clip) -> DataFrame:
    """One row for the constant forecast: ``rate, log_loss, brier, n``."""
    known = df.where(F.col(y).isNotNull()).agg(F.avg(F.col(y).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
    rate = clip(F.col("mean"), epsilon)
    # the mean loss of a constant is linear in the mean outcome
    loss = -(F.col("mean") * F.log(rate) + (1 - F.col("mean")) * F.log(1 - rate))
    score = F.col("mean") * F.pow(1 - rate, F.lit(2.0)) + (1 - F.col("mean")) * F.pow(rate, F.lit(2.0))
    return known.select(rate.alias("rate"), loss.alias("log_loss"), score.alias("brier"), "n")


def skill(df: DataFrame, p: str, y: str, frozen_rate: float, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row: the forecast against a frozen constant, with both gains and whether both gates pass."""
    rate = clip(F.lit(frozen_rate))
    got = df.agg(
        F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"), F.avg(brier(F.col(p), F.col(y))).alias("brier"),
        F.avg(log_loss(rate, F.col(y))).alias("base_log_loss"), F.avg(brier(rate, F.col(y))).alias("base_brier"),
        F.count(F.lit(1)).alias("n"),
    ).withColumns({"log_loss_gain": F.col("base_log_loss") - F.col("log_loss"), "brier_gain": F.col("base_brier") - F.col("brier")})
    passed = (F.col("log_loss_gain") >= config.holdout_log_loss_gain) & (F.col("brier_gain") >= config.holdout_brier_gain)
    return got.withColumn("passed", passed)


def health(df: DataFrame, at: str, status: str, now: Column, hours: int = DEFAULT.stale_after_hours) -> DataFrame:
    """One row: red if there is nothing or the newest is old, amber if any is not OK, else green."""
    got = df.agg(F.max(at).alias("newest"), F.count_if(~F.col(status).eqNullSafe("OK")).alias("not_ok"), F.count(F.lit(1)).alias("n"))
    old = F.col("newest").isNull() | (F.col("newest") < now - F.make_interval(hours=F.lit(hours)))
    return got.withColumn("dot", F.when((F.col("n") == 0) | old, "red").when(F.col("not_ok") > 0, "amber").otherwise("green"))


def slices(df: DataFrame, by: Sequence[str], p: str, y: str) -> DataFrame:
    return summary(df, p, y, by).orderBy(F.desc("n"), *by)
