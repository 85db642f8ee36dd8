"""Scalar rules on literal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.vennabers import fast_values


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_prices(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert value(spark, X.american_probability(lit(150.0))) == pytest.approx(0.4)
    assert value(spark, X.american_probability(lit(-150.0))) == pytest.approx(0.6)
    assert value(spark, X.american_probability(lit(0.0))) is None
    assert value(spark, X.american_probability(lit("NaN"))) is None
    assert value(spark, X.no_vig(lit(0.6), lit(0.6))) == pytest.approx(0.5)
    assert value(spark, X.no_vig(lit(0.0), lit(0.6))) is None


def test_shrink_and_rows(spark):
    assert value(spark, X.shrink_to_group(F.lit(0.6), F.lit(0.5), F.lit(20.0))) == pytest.approx(0.55)
    assert value(spark, X.shrink_to_group(F.lit(0.6), F.lit(None).cast("double"), F.lit(20.0))) == 0.6
    assert value(spark, X.effective_rows(F.lit(10.0), F.lit(None).cast("double"), F.lit(0.9))) == pytest.approx(9.0)


def test_market_reasons(spark):
    reason = lambda p, n, a: value(spark, X.market_reason(F.lit(p).cast("double"), F.lit(n), F.lit(a).cast("double")))
    assert reason(0.5, 3, 120) is None
    assert reason(None, 3, 120) == "no_market_consensus"
    assert reason(0.5, 1, 120) == "books_1_below_2"
    assert reason(0.5, 3, None) == "odds_age_unknown"
    assert reason(0.5, 3, -1) == "odds_timestamp_in_future"
    assert reason(0.5, 3, 900) == "odds_stale_900s"


def test_display(spark):
    assert value(spark, X.display_percent(F.lit(0.388))) == pytest.approx(61.2)
    assert value(spark, X.display_edge(F.lit(-0.028))) == pytest.approx(2.8)
    assert value(spark, X.display_percent(F.lit(None).cast("double"))) is None
    assert value(spark, X.coverage_reason(F.lit(0.62))) == "coverage_0.62_below_0.85"


def test_unique_or_null(spark):
    one = lambda *v: value(spark, X.unique_or_null(F.array(*[F.lit(x).cast("int") for x in v])))
    assert one(5, 5, None) == 5 and one(5, 6) is None and one(None) is None


def hull_slopes(n: np.ndarray, y: np.ndarray, label: int) -> np.ndarray:
    """Isotonic value of one more point with ``label`` at each place among ``2m + 1`` (gap, knot, gap, ...).

    The value at a place is the largest over left ends of the smallest over right ends of block means
    that hold the place; running over places with a stack of blocks costs a scan for each.
    """
    m = len(n)
    out = np.empty(2 * m + 1)
    cn, cy = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(y)])
    for place in range(2 * m + 1):
        left_ends = np.arange(place // 2 + 1)
        right_ends = np.arange((place + 1) // 2, m + 1)
        num = cy[right_ends][None, :] - cy[left_ends][:, None] + label
        den = cn[right_ends][None, :] - cn[left_ends][:, None] + 1
        out[place] = (num / den).min(axis=1).max()
    return out


def test_calibration_table_equals_definition():
    rng = np.random.default_rng(7)
    for _ in range(100):
        n = rng.integers(1, 5, rng.integers(1, 12)).astype(float)
        y = np.array([rng.integers(0, int(k) + 1) for k in n], float)
        p0, p1 = fast_values(n, y, 0), fast_values(n, y, 1)
        assert np.allclose(p0, hull_slopes(n, y, 0)) and np.allclose(p1, hull_slopes(n, y, 1))
        assert (p0 <= p1 + 1e-12).all() and (np.diff(p0) >= -1e-12).all() and (np.diff(p1) >= -1e-12).all()


def test_json_put_keeps_types(spark):
    text = '{"a":{"b":1},"n":2.5}'
    assert value(spark, X.json_put(F.lit(text), "s", F.lit("x"))) == '{"a":{"b":1},"n":2.5,"s":"x"}'
    assert value(spark, X.json_put(F.lit("[1]"), "s", F.lit("x"))) == '{"s":"x"}' == value(spark, X.json_put(F.lit(None).cast("string"), "s", F.lit("x")))


def test_weather_missing(spark):
    lit = lambda x: F.lit(x).cast("double")
    gone = lambda dome, t, w: value(spark, X.weather_missing(F.lit(dome), lit(t), lit(w)))
    assert (gone(False, 70, None), gone(False, None, 8), gone(False, 70, 8), gone(True, None, None), gone(None, 70, None)) == (1.0, 1.0, 0.0, 0.0, 1.0)
