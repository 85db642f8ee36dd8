"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training progress ``t`` in [0, 1], a piecewise linear
function given by knots. Its integral is the source's share of the demand. Shares become token
targets by water filling: no source may be read more than ``max_passes`` times, and what a
capped source cannot take is shared again by weight. A document covers an interval of its
source's cumulative tokens on every pass; inverting the source's cumulative demand at the middle
of that interval gives the training position, and the result is range-sorted by position.

Documents lie within their source in the order of a hash of their id. The running sum over that
order is taken in two levels, so a source that holds a third of all rows is summed by many
tasks: per (source, hash bucket) first, then within each bucket.

Results in odd cases: a null text has size 0 and takes nothing; null sources form one source that
comes last; repeated rows are separate documents of one id; an empty table gives an empty result.
Columns besides id, source and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, word_count

Knots = Sequence[tuple[float, float]]

#: Integrals 5, 2 and 1: heavy sources gain share during training, light ones fade.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 4.0), (1.0, 6.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 1.5), (1.0, 0.5)),
)


def integral(knots: Knots) -> float:
    """Integral of the piecewise linear schedule over its knots."""
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))


def invert_demand(share: Column, knots: Knots) -> Column:
    """The ``t`` at which ``share`` (0 to 1) of the schedule's integral has been demanded."""
    total, done, out = integral(knots), 0.0, None
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        part = (t1 - t0) * (a + b) / 2
        if part <= 0:
            continue
        c = share * F.lit(total) - F.lit(done)
        slope = (b - a) / (t1 - t0)
        root = F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * slope) * c, F.lit(0.0)))
        t = F.when(c > 0, F.lit(t0) + F.lit(2.0) * c / root).otherwise(F.lit(t0))
        done += part
        here = share * F.lit(total) <= F.lit(done)
        out = F.when(here, t) if out is None else out.when(here, t)
    return out.otherwise(F.lit(knots[-1][0]))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_passes: int) -> DataFrame:
    """One row per source: ``key, class, source_size, target``; the windows run over source rows."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("class", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumns(
        {
            "weight": weight,
            "cap": (F.lit(max_passes) * F.col("source_size")).cast("double"),
            "total": F.sum("source_size").over(everything).cast("double"),
            "weights": F.sum(weight).over(everything),
        }
    )
    before = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    free = F.col("cap") / F.col("weight") > F.col("level")
    shared = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)
    per = per.withColumn("shared", shared["level"])
    target = F.when(free, F.col("shared") * F.col("weight")).otherwise(F.col("cap"))
    return per.select("key", "class", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    schedules: Sequence[Knots] = SCHEDULES,
    max_passes: int = 3,
) -> DataFrame:
    """One row per document in training order of its first pass:
    ``doc_id, size, source_size, target, taken, position, positions``.

    ``schedules`` go to the sources by code point, null last, repeating. ``taken`` counts the
    words over all passes; the taken words of a source add up to its target, rounded. ``positions``
    has one training position per pass, ``position`` the first; null if nothing is taken.
    """
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null")).alias("key"),
        h.alias("h"),
        word_count(F.col(text_col)).alias("size"),
    )
    sizes = stage(sizes, "mix-sizes").withColumn("bucket", F.substring("h", 1, 3))
    targets = source_targets(sizes, [integral(k) for k in schedules], max_passes)
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sizes.groupBy("key", "bucket")
        .agg(F.sum("size").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .join(targets, "key")
        .drop("n")
    )
    within = (
        Window.partitionBy("key", "bucket")
        .orderBy("h", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = sizes.join(buckets, ["key", "bucket"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    laid = laid.withColumns({"wanted": wanted, "whole": whole.cast("long")})
    rest = F.col("wanted") - F.col("whole") * F.col("source_size") - F.col("start")
    laid = laid.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    passes = F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0))
    laid = laid.withColumns({"taken": F.col("whole") * F.col("size") + F.col("part"), "passes": passes})

    def position(k: Column) -> Column:
        length = F.when(k < F.col("whole"), F.col("size")).otherwise(F.col("part"))
        middle = (k * F.col("source_size") + F.col("start")).cast("double") + length.cast("double") / 2.0
        share = middle / F.col("wanted").cast("double")
        out = None
        for i, knots in enumerate(schedules):
            here = F.col("class") == i
            t = invert_demand(share, knots)
            out = F.when(here, t) if out is None else out.when(here, t)
        return out

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), position)
    laid = laid.withColumn(
        "positions", F.when(F.col("passes") > 0, every).otherwise(F.array().cast("array<double>"))
    )
    first = F.when(F.col("passes") > 0, F.element_at("positions", 1))
    return laid.select(
        "doc_id", "size", "source_size", "target", "taken", first.alias("position"), "positions"
    ).orderBy(F.asc_nulls_last("position"), "doc_id")


def training_order(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix reads it, range-sorted by training position.

    Documents stay whole: of a last pass that takes only a part, one of half a document and
    more counts. Rows that repeat an id are read as the mix of their id says.
    """
    plan = mix(docs, id_col, **options).select(
        F.col("doc_id").alias("_mix_id"), "size", "taken", F.col("positions").alias("_mix_at")
    )
    reads = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    plan = plan.groupBy("_mix_id").agg(F.max(F.slice("_mix_at", F.lit(1), reads)).alias("_mix_at"))
    plan = stage(plan.where(F.size("_mix_at") > 0), "mix-plan")
    # rows ride packed, so their columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    read = rows.join(plan, F.col("id").eqNullSafe(F.col("_mix_id"))).select("row", "id", F.explode("_mix_at").alias("at"))
    return read.orderBy("at", "id").select("row.*")
