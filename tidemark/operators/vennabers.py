"""Inductive Venn-ABERS calibration as a table.

For each model the calibration pairs are counted per score on Spark. The interval table holds, at
every score and in every gap between scores, the isotonic value of a test point labelled 0 (``p0``)
and 1 (``p1``) (Vovk, Petej and Fedorova 2015). Scoring is a lookup.

A model of many scores is cut into ranges of scores. Each range is pooled (PAVA) in a task of its own;
the pooled blocks of a model are merged from both ends, and each range builds its part of the table with the blocks
before and behind it that can matter to it: those that a point in the range, with all that it may pool, can reach
(``reached``). Pooling in parts gives the blocks of the whole. Merging takes 24 bytes a pooled block and side, once per model; a
model whose rates rise strictly with its scores, which pools nothing, still hands each range a few blocks.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.io import ContractError

TABLE = "model string, lo double, hi double, knot boolean, p0 double, p1 double"
#: Distinct scores of a model that one task takes, about.
RANGE_SCORES = 1 << 17
_BLOCKS = "model string, _r int, _i int, n double, pos double, most double"
_CARRY = "model string, _r int, before double, behind boolean, ln array<double>, ly array<double>, rn array<double>, ry array<double>"


def interval_table(pdf: pd.DataFrame, carry: pd.DataFrame | None = None) -> pd.DataFrame:
    """Knots and gaps of one model, or of one range with what it carries in. Values change only where the
    isotonic fits do, so neighbouring entries of equal values are kept apart only by their score."""
    pdf = pdf.sort_values("s")
    s, n, y = (pdf[c].to_numpy(np.float64) for c in ("s", "n", "pos"))
    c = None if carry is None else carry.iloc[0]
    left, right = ((), ()) if c is None else (stacked(c["ln"], c["ly"]), stacked(c["rn"], c["ry"]))
    values = {label: fast_values(n, y, label, left, right) for label in (0, 1)}
    lo = np.empty(2 * len(s) + 1)
    hi = np.empty(2 * len(s) + 1)
    lo[0], lo[1::2], lo[2::2] = -np.inf, s, s
    hi[-1], hi[1::2], hi[0:-1:2] = np.inf, s, s
    out = pd.DataFrame({"model": pdf["model"].iloc[0], "lo": lo, "hi": hi, "knot": np.arange(len(lo)) % 2 == 1, "p0": values[0], "p1": values[1]})
    if c is None:
        return out
    out.loc[0, "lo"] = c["before"]
    return out.iloc[:-1] if c["behind"] else out  # the gap to the next range is that range's first


def stacked(n, y) -> tuple:
    """Blocks as a linked stack; the last is on top."""
    node: tuple = ()
    for a, b in zip(n, y):
        node = (float(a), float(b), node)
    return node


class Blocks:
    """Stacks of pooled blocks that share their lower parts. A stack is the number of its top block, -1 where it is empty;
    a push leaves the stack that it starts from as it was.

    ``up`` is 1 for blocks from the left, whose rates rise towards the top, and -1 for blocks from the right, whose rates fall.
    """

    def __init__(self, up: int):
        self.up, self.n, self.y, self.below = up, array("d"), array("d"), array("q")

    def pushed(self, top: int, rows) -> int:
        """The stack with ``rows`` of ``(n, positives)`` on it, pooled while they violate the order."""
        n, y, below, up = self.n, self.y, self.below, self.up
        for a, b in rows:
            while top >= 0 and up * (y[top] * a - b * n[top]) >= 0:
                a, b, top = a + n[top], b + y[top], below[top]
            n.append(a)
            y.append(b)
            below.append(top)
            top = len(n) - 1
        return top


def reached(side: Blocks, top: int, other: Blocks, facing: int) -> tuple[list[float], list[float]]:
    """Sizes and positives of the blocks of a stack, the nearest last, that a point on its other side can pool with, where
    the stack ``facing`` of ``other`` has the fit of all rows there.

    The point and rows from the other side pool with a block of rate m only if, taken from the border, their sum of
    (positives - m * size) reaches it. That sum is most extreme for the point's own label 0 (towards the left) or 1 (towards
    the right) and for the blocks of the facing fit whose rates lie beyond m; nothing deeper than the first block which even
    that doesn't reach can matter.
    """
    if top < 0:
        return [], []
    up, label = side.up, 0.0 if side.up > 0 else 1.0
    ahead = [(0.0, 0.0)]  # sizes and positives of the facing blocks that lie beyond the nearest rate, summed from the border
    rates = []
    while facing >= 0 and up * (side.y[top] * other.n[facing] - other.y[facing] * side.n[top]) > 0:
        a, b = ahead[-1]
        ahead.append((a + other.n[facing], b + other.y[facing]))
        rates.append(facing)
        facing = other.below[facing]
    n, y, a, b = [], [], 1.0, label
    while top >= 0:
        while rates and up * (side.y[top] * other.n[rates[-1]] - other.y[rates[-1]] * side.n[top]) <= 0:
            rates.pop()
        c, d = ahead[len(rates)]
        if up * (side.y[top] * (a + c) - (b + d) * side.n[top]) < 0:
            break
        n.append(side.n[top])
        y.append(side.y[top])
        a, b, top = a + side.n[top], b + side.y[top], side.below[top]
    return n[::-1], y[::-1]


def range_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pooled blocks of one range in order, with the range's largest score."""
    pdf = pdf.sort_values("s")
    blocks = Blocks(1)
    top, chain = blocks.pushed(-1, zip(pdf["n"].to_numpy(np.float64).tolist(), pdf["pos"].to_numpy(np.float64).tolist())), []
    while top >= 0:
        chain.append((blocks.n[top], blocks.y[top]))
        top = blocks.below[top]
    blocks = np.array(chain[::-1])
    return pd.DataFrame({"model": pdf["model"].iloc[0], "_r": pdf["_r"].iloc[0], "_i": np.arange(len(blocks)), "n": blocks[:, 0], "pos": blocks[:, 1], "most": pdf["s"].iloc[-1]})


def carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every range of a model: the blocks before it and behind it that it can reach, each nearest last."""
    pdf = pdf.sort_values(["_r", "_i"])
    r, most = pdf["_r"].to_numpy(), pdf["most"].to_numpy(np.float64)
    n, y = pdf["n"].to_numpy(np.float64), pdf["pos"].to_numpy(np.float64)
    cuts = np.flatnonzero(np.diff(r)) + 1
    spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]))
    left, right = Blocks(1), Blocks(-1)
    before, behind = [-1], [-1]  # stacks at the borders of ranges, from either end
    for a, b in spans:
        before.append(left.pushed(before[-1], zip(n[a:b].tolist(), y[a:b].tolist())))
    for a, b in reversed(spans):
        behind.append(right.pushed(behind[-1], zip(n[a:b][::-1].tolist(), y[a:b][::-1].tolist())))
    behind.reverse()
    out = []
    for i, (a, b) in enumerate(spans):
        ln, ly = reached(left, before[i], right, behind[i])
        rn, ry = reached(right, behind[i + 1], left, before[i + 1])
        out.append((pdf["model"].iloc[0], r[a], most[a - 1] if i else -np.inf, i + 1 < len(spans), ln, ly, rn, ry))
    return pd.DataFrame(out, columns=["model", "_r", "before", "behind", "ln", "ly", "rn", "ry"])


def fast_values(n: np.ndarray, y: np.ndarray, label: int, left: tuple = (), right: tuple = ()) -> np.ndarray:
    """Isotonic value of one more point with ``label`` at each place among ``2m + 1`` (gap, knot, gap, ...), in near-linear time: the point joins the pooled blocks to its left and right
    while they violate the order. ``left`` and ``right`` are the blocks beyond both ends."""
    m = len(n)
    out = np.empty(2 * m + 1)
    # prefixes pooled from the left, suffixes pooled from the right, as persistent stacks
    pre, suf = [left], [right]
    for i in range(m):
        node, a, b = pre[-1], n[i], y[i]
        while node and node[1] * a >= b * node[0]:
            a, b, node = a + node[0], b + node[1], node[2]
        pre.append((a, b, node))
    for i in range(m - 1, -1, -1):
        node, a, b = suf[-1], n[i], y[i]
        while node and b * node[0] >= node[1] * a:
            a, b, node = a + node[0], b + node[1], node[2]
        suf.append((a, b, node))
    suf.reverse()
    for place in range(2 * m + 1):
        a, b = 1.0, float(label)
        l, r = pre[place // 2], suf[(place + 1) // 2]
        if place % 2:  # at a knot the point shares its score with the pairs there
            i = place // 2
            a, b = a + n[i], b + y[i]
        changed = True
        while changed:
            changed = False
            while l and l[1] * a >= b * l[0]:
                a, b, l, changed = a + l[0], b + l[1], l[2], True
            while r and b * r[0] >= r[1] * a:
                a, b, r, changed = a + r[0], b + r[1], r[2], True
        out[place] = b / a
    return out


def in_ranges(df: DataFrame, model: str, score: str, most: int) -> DataFrame | None:
    """``df`` with ``_r``, the number of its range of scores, where a model has more than ``most`` rows; None
    if no model has. Cuts are taken from a quantile sketch once, so that a score's range never changes."""
    sizes = df.groupBy(F.col(model).alias("_rm")).agg(F.count(F.lit(1)).alias("_rn")).where(F.col("_rn") > most)
    if (largest := sizes.agg(F.max("_rn")).first()[0]) is None:
        return None
    n = -(-largest // most)
    finite = df.where(f"abs({score}) < double('infinity')").join(F.broadcast(sizes), F.col(model) == F.col("_rm"))
    cuts = finite.groupBy("_rm").agg(F.percentile_approx(score, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("_cuts")).collect()  # numbers of large models only
    known = df.sparkSession.createDataFrame([(r["_rm"], sorted(set(r["_cuts"]))) for r in cuts], "_rm string, _cuts array<double>")
    joined = df.join(F.broadcast(known), F.col(model) == F.col("_rm"), "left")
    place = F.size(F.filter("_cuts", lambda c: c < F.col(score)))
    return joined.withColumn("_r", F.when(F.col("_cuts").isNotNull(), place).otherwise(0)).drop("_rm", "_cuts")


def calibrate(pairs: DataFrame, model: str, score: str, label: str, least: int = 50, digits: int | None = None, range_scores: int = RANGE_SCORES) -> DataFrame:
    """Interval table of every model with at least ``least`` pairs. Null and NaN scores and null labels take no part."""
    s = F.round(F.col(score), digits) if digits is not None else F.col(score)
    counts = pairs.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy(F.col(model).alias("model"), s.cast("double").alias("s"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    enough = counts.groupBy("model").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select("model")
    counts = counts.join(F.broadcast(enough), "model", "left_semi")
    cut = in_ranges(counts, "model", "s", range_scores)
    if cut is None:
        return counts.groupBy("model").applyInPandas(lambda pdf: interval_table(pdf), TABLE)
    carry = cut.groupBy("model", "_r").applyInPandas(range_blocks, _BLOCKS).groupBy("model").applyInPandas(carried, _CARRY)
    return cut.groupBy("model", "_r").cogroup(carry.groupBy("model", "_r")).applyInPandas(interval_table, TABLE)


def require_pairs(pairs: DataFrame, least: int = 50) -> None:
    if (n := pairs.count()) < least:
        raise ContractError(f"{n} calibration pairs, {least} needed")


def apply(scores: DataFrame, table: DataFrame, model: str, score: str, range_scores: int = RANGE_SCORES) -> DataFrame:
    """``scores`` with ``p0, p1, p_cal`` and ``width``, null for scores that are null or NaN. Table rows and scores are laid in one order per
    model and range of scores; a score takes the knot at its place, or else the gap above the last
    knot, which is carried in from the ranges before where its own has none. Scores are not joined by range."""
    known = table.select(F.col("model").alias("_m"), F.col("lo").alias("_s"), F.when(F.col("knot"), 1).otherwise(2).alias("_o"), "p0", "p1", "hi")
    knots = known.where("_o = 1").select("_m", "_s", F.col("p0").alias("_k0"), F.col("p1").alias("_k1"))
    distinct = scores.select(F.col(model).alias("_m"), F.col(score).cast("double").alias("_s")).where("_s IS NOT NULL AND NOT isnan(_s)").distinct()
    both = known.where("_o = 2 OR _s = double('-infinity')").select("_m", "_s", "p0", "p1", F.lit(0).alias("_ask")).unionByName(
        distinct.withColumns({"p0": F.lit(None).cast("double"), "p1": F.lit(None).cast("double"), "_ask": F.lit(1)})
    )
    cut = in_ranges(both, "_m", "_s", range_scores)
    ranged = both.withColumn("_r", F.lit(0)) if cut is None else cut
    order = Window.partitionBy("_m", "_r").orderBy("_s", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    gap = ranged.select("_m", "_r", "_s", "_ask", F.last("p0", True).over(order).alias("_g0"), F.last("p1", True).over(order).alias("_g1")).where("_ask = 1").drop("_ask")
    if cut is not None:
        ends = cut.groupBy("_m", "_r").agg(F.max_by(F.when(F.col("_ask") == 0, F.struct("p0", "p1")), F.when(F.col("_ask") == 0, F.col("_s"))).alias("_e"))
        earlier = Window.partitionBy("_m").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        ends = ends.select("_m", "_r", F.last("_e", True).over(earlier).alias("_e"))
        gap = gap.join(F.broadcast(ends), ["_m", "_r"], "left").withColumns({"_g0": F.coalesce("_g0", "_e.p0"), "_g1": F.coalesce("_g1", "_e.p1")})
    found = gap.join(knots, ["_m", "_s"], "left").select("_m", "_s", F.coalesce("_k0", "_g0").alias("p0"), F.coalesce("_k1", "_g1").alias("p1"))
    out = scores.join(found, (F.col(model) == F.col("_m")) & (F.col(score).cast("double") == F.col("_s")), "left").drop("_m", "_s")
    return out.withColumns({"p_cal": F.col("p1") / (1 - F.col("p0") + F.col("p1")), "width": F.col("p1") - F.col("p0")})
