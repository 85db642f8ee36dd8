"""The catalogue's histories on rows made here."""

from dataclasses import replace
from datetime import date, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.plans import catalogue


def tables(spark):
    lines = [(i // 3, i % 40, i % 25, i % 3 + 1, float(i % 50), 0.01 * (i % 7), 0.01 * (i % 5), date(1995, 1, 1) + timedelta(days=i % 60)) for i in range(900)]
    lines += [(900, None, 1, 1, 2.0, 0.0, 0.0, date(1995, 1, 2)), (901, 3, 1, 1, 2.0, 0.0, 0.0, None)]
    orders = [(i, i % 30, 100.0 * i, "F", date(1995, 2, 1) + timedelta(days=i % 60)) for i in range(300)]
    return SimpleNamespace(
        spark=spark,
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate date"),
        orders=spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate date"),
        nation=spark.createDataFrame([(i, f"n{i}") for i in range(25)], "n_nationkey int, n_name string"),
    )


def test_only_the_pitchers_that_are_asked_for_are_summed(spark):
    """rows of other pitchers are left out before they are dealt and summed, although days are tested behind the sum."""
    t = tables(spark)
    keys = spark.createDataFrame([(3,), (5,), (77,)], "_wanted long")
    whole, some = catalogue.histories(t), catalogue.histories(t).of_pitchers(keys)
    for name in ("pitcher_games", "pitcher_innings", "statcast_daily"):
        rows = getattr(some, name)
        want = getattr(whole, name).where("pitcher_id IN (3, 5, 77)")
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count() > 0
        plan = rows.where(F.col("game_date").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and ("Aggregate" not in plan or plan.index("Aggregate") < plan.index("LeftSemi"))
    assert some.batter_games.count() == whole.batter_games.count()


def test_the_entity_family_asks_for_its_pitchers_alone(spark):
    """the family takes histories of its keys, and its values are those of whole histories."""
    t, asked = tables(spark), []
    h = catalogue.histories(t)

    def of_pitchers(keys):
        asked.append({r["_wanted"] for r in keys.collect()})
        return h.of_pitchers(keys)

    sides = spark.createDataFrame([(1, "away", date(1995, 3, 1), 3), (1, "home", date(1995, 3, 1), None), (2, "away", date(1995, 1, 20), 5)], "rid long, role string, d date, entity long")
    got = [features.entity_family(replace(h, of_pitchers=x), sides)[0].orderBy("rid", "role").collect() for x in (of_pitchers, None)]
    assert asked == [{3, 5}] and got[0] == got[1] and got[0][0]["p_career_ip"] > 0
