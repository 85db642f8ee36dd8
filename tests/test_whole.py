"""Queries answer every row of their tables."""

import os

import pytest

from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_catalogue_covers_every_order(spark):
    orders = {r["o_orderkey"] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()}
    filled = {r["l_orderkey"] for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").collect()}
    rows = QUERIES["n02_feature_catalogue"](spark, FOLDER).select("rid", "away_lineup_top3_woba", "home_lineup_top3_obp", "away_lineup_missing").collect()
    assert len(rows) == len(orders) and {r["rid"] for r in rows} == orders and orders - filled
    assert all(tuple(r)[1:] == (None, None, 1.0) for r in rows if r["rid"] not in filled)


@pytest.mark.parametrize("mode", ["append", "complete", "update"])
def test_replayed_rows_are_files(spark, tmp_path, mode):
    from tidemark.plans.queries import _replay
    from tidemark.plans.views import Tables

    t = Tables(spark, FOLDER)
    make = (lambda s: s.select("event_id")) if mode == "append" else (lambda s: s.groupBy("user_id").count())
    got = _replay(t, "whole", make, mode).drop("batch")
    assert got.inputFiles()
    want = t.events.select("event_id") if mode == "append" else t.events.groupBy("user_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stack_uses_the_whole_protocol(spark, monkeypatch):
    from tidemark.plans import model, queries
    from tidemark.plans.views import Tables

    def seen(rows, *args, config, members=None, candidates=None, **more):
        assert config.folds == 5 and config.min_fold_rows == 200 and set(members or model.MEMBERS) == {"boosted", "linear"}
        raise InterruptedError

    monkeypatch.setattr(model, "train", lambda df, f, y, d, k, members, candidates, config: seen(df, members=members, candidates=candidates, config=config))
    monkeypatch.setattr(queries, "_bundles", {})
    for version in queries.TARGETS:
        with pytest.raises(InterruptedError):
            queries.bundle(Tables(spark, FOLDER), version)


def test_boosting_is_patient(spark):
    import numpy as np

    from tidemark.plans import model

    assert model.best_round([3, 2, 2, 1, 5, 5], 2) == (4, True) and model.best_round([3, 2, 2, 2, 1], 2) == (2, True)
    assert model.best_round([3, 2, 1], 2) == (3, False) and model.MOST_ROUNDS == 1000 and model.PATIENCE == 50
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(float(a), float(b), int(a * b > 0)) for a, b in x], "a double, b double, y int").cache()
    # a rule that can be learnt goes on gaining after the former cap
    assert model.rounds_of(model.boosted_member(["a", "b"], "y", None, 60).fit(rows)) > 30
    linear = model.linear_member(["a", "b"], "y").fit(rows).stages[-1]
    assert linear.getRegParam() == pytest.approx(1 / 400)
