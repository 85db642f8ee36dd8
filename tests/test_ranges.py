"""Venn-ABERS tables built in ranges of scores equal those of whole models."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import vennabers


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(4)
    out = []
    for model, n, digits in (("a", 1500, 9), ("b", 400, 2), ("c", 60, 9), ("few", 20, 9)):
        p = np.round(rng.random(n), digits)
        out += [(model, float(s), int(rng.random() < s)) for s in p]
    out += [("sharp", i / 300, int(i >= 150)) for i in range(300)]
    return out


def columns(df):
    return df.toPandas().sort_values(["model", "lo", "knot"]).reset_index(drop=True)


def test_ranges_equal_whole_models(spark, pairs):
    df = spark.createDataFrame(pairs, "model string, p double, y int").cache()
    whole = vennabers.calibrate(df, "model", "p", "y")
    parts = vennabers.calibrate(df, "model", "p", "y", range_scores=70)
    assert vennabers.in_ranges(df, "model", "p", 70).select("model", "_r").distinct().where("model = 'a'").count() > 10
    pd.testing.assert_frame_equal(columns(whole), columns(parts))
    assert whole.where("model = 'few'").count() == 0
    asked = df.select("model", "p").union(spark.createDataFrame([(m, float(p)) for m in ("a", "b", "sharp", "few") for p in (-1.0, 0.12345, 0.5001, 2.0)], "model string, p double"))
    # many scores above the last knot: their ranges hold no row of the table
    asked = asked.union(spark.range(300).selectExpr("'c'", "2D + id")).distinct()
    one, many = (sorted(vennabers.apply(asked, whole, "model", "p", n).collect(), key=str) for n in (1 << 20, 50))
    assert one == many


def test_nan_takes_no_part(spark, pairs):
    df = spark.createDataFrame([p for p in pairs if p[0] == "c"], "model string, p double, y int")
    odd = df.union(spark.createDataFrame([("c", float("nan"), 1), ("c", None, 1)], df.schema))
    table = vennabers.calibrate(odd, "model", "p", "y")
    pd.testing.assert_frame_equal(columns(table), columns(vennabers.calibrate(df, "model", "p", "y")))
    got = vennabers.apply(odd.where("p IS NULL OR isnan(p)"), table, "model", "p").collect()
    assert len(got) == 2 and all(r["p0"] is None and r["p_cal"] is None for r in got)


def test_orders_in_ranges(spark):
    from tidemark.operators import latest
    from tidemark.operators.ranges import exact_median, in_ranges

    rng = np.random.default_rng(3)
    days = np.sort(rng.integers(0, 500, 400))
    days[[50, 51, 200]] = days[[51, 50, 0]]
    rows = spark.createDataFrame([(i, int(d)) for i, d in enumerate(days)], "p int, d int").repartition(5)
    want = int((np.diff(days) < 0).sum())
    assert [latest.monotonic(rows, "p", "d", n).first()["n_back"] for n in (7, 1 << 20)] == [want, want]
    assert in_ranges(rows, "p", 50).select("_r").distinct().count() == 8
    for values in ([1.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0, 9.0, None], list(map(float, days))):
        known = [v for v in values if v is not None]
        got = exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()["median"]
        assert got == pytest.approx(float(np.median(known)))


def test_medians_of_hot_groups(spark):
    """A group with a third of all rows, ties, null keys and null values: the same with and without ranges, and no task holds a hot group."""
    from tidemark.operators import market
    from tidemark.operators.ranges import exact_medians, group_ranges

    rng = np.random.default_rng(8)
    rows = [(None if i % 13 == 0 else "hot" if i % 3 == 0 else f"k{i % 7}", None if i % 11 == 0 else float(rng.choice([1.5, rng.random(), 7.0]))) for i in range(3000)]
    rows += [("nulls", None), ("nulls", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    want = {}
    for k, x in rows:
        want.setdefault(k, []).extend([x] if x is not None else [])
    want = {k: float(np.median(v)) if v else None for k, v in want.items()}
    for n in (40, 1 << 20):
        assert {r["k"]: r["median"] for r in exact_medians(df, ["k"], "x", rows=n).collect()} == pytest.approx(want)
        assert {r["k"]: r["p_close"] for r in market.closing_price(df, ["k"], "x", n).collect()} == pytest.approx(want)
        total = [x for _, x in rows if x is not None]
        assert exact_medians(df, [], "x", rows=n).first()["median"] == pytest.approx(float(np.median(total)))
    counts = df.where("x IS NOT NULL").groupBy("k", "x").count()
    ranged = group_ranges(counts, ["k"], "x", 40).groupBy("k", "_r").count().collect()
    assert max(r["count"] for r in ranged) < 80 and sum(r["k"] == "hot" for r in ranged) > 5


def test_consensus_of_a_hot_matchup(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import market

    quotes = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("m"), (F.col("id") / 1000).alias("p"), F.lit(-110.0).alias("price"), F.timestamp_seconds(F.col("id")).alias("at"))
    now = F.timestamp_seconds(F.lit(1000))
    one, many = (sorted(map(tuple, market.consensus(quotes, ["m"], "p", "price", "at", now, range_rows=n).collect())) for n in (1 << 20, 30))
    assert one == many and len(one) == 20 and sum(r[3] for r in one) == 500 and all(r[1] is not None for r in one)


def frames_of(kind, rng, n):
    """Counts per score of a model: ``n`` scores with sizes and positives."""
    size = rng.integers(1, 30, n).astype(float)
    rate = {"rising": np.linspace(0, 1, n), "falling": np.linspace(1, 0, n), "drop": np.where(np.arange(n) < 0.7 * n, np.linspace(0, 1, n), 0.0), "random": rng.random(n), "waves": 0.5 + 0.5 * np.sin(np.arange(n) / 9), "steps": np.round(np.linspace(0, 1, n), 1)}[kind]
    return pd.DataFrame({"model": "m", "s": np.arange(n) / n, "n": size, "pos": np.minimum(np.round(size * rate), size)})


@pytest.mark.parametrize("kind", ["rising", "falling", "drop", "random", "waves", "steps"])
def test_carried_blocks_suffice(kind):
    """Ranges with the blocks that they can reach build the table of the whole model."""
    rng = np.random.default_rng(2)
    for n, width in ((60, 7), (200, 13), (200, 90)):
        pdf = frames_of(kind, rng, n).assign(_r=lambda d, w=width: np.arange(len(d)) // w)
        carry = vennabers.carried(pd.concat([vennabers.range_blocks(g) for _, g in pdf.groupby("_r")]))
        parts = [vennabers.interval_table(g.drop(columns="_r"), carry[carry["_r"] == r]) for r, g in pdf.groupby("_r")]
        pd.testing.assert_frame_equal(pd.concat(parts).reset_index(drop=True), vennabers.interval_table(pdf.drop(columns="_r")).reset_index(drop=True))


def test_a_rising_model_of_a_million_scores_carries_little():
    """Nothing pools in it, and each of its ranges still gets a few blocks only."""
    n = 1_000_000
    size = np.full(n, 4.0 * n)
    blocks = pd.DataFrame({"model": "m", "_r": np.arange(n) // (1 << 17), "_i": np.arange(n) % (1 << 17), "n": size, "pos": np.arange(n) * 4.0, "most": np.arange(n) / n})
    carry = vennabers.carried(blocks)
    assert len(carry) == 8 and max(len(x) for c in ("ln", "rn") for x in carry[c]) < 2000
    assert carry["behind"].tolist() == [True] * 7 + [False] and carry["before"].tolist()[1:] == [(k * (1 << 17) - 1) / n for k in range(1, 8)]
