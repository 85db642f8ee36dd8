"""The stacked classifier: folds keep their purge gap, members plug in, saved models score alike."""

import tempfile
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.config import DEFAULT
from tidemark.operators import folds
from tidemark.plans import model
from tidemark.sources.io import ContractError

CONFIG = replace(DEFAULT, folds=2, min_fold_rows=50)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    out = []
    for i in range(600):
        x = rng.normal(size=3)
        y = int(rng.random() < 1 / (1 + np.exp(-2 * x[0])))
        out.append((i, date(2024, 1, 1) + timedelta(days=i // 4), y, *[None if rng.random() < 0.03 else float(v) for v in x], None))
    return spark.createDataFrame(out, "id int, d date, y int, a double, b double, c double, void double").cache()


def test_folds_expand_and_keep_the_gap(rows):
    placed = folds.positions(rows, "d", "id")
    table = folds.fold_table(placed, "d", CONFIG).orderBy("fold").collect()
    assert [r["fold"] for r in table] == [1, 2] and table[0]["n_train"] < table[1]["n_train"]
    spans = {(r["fold"], r["part"]): r for r in folds.members(placed, folds.fold_table(placed, "d", CONFIG), "d").groupBy("fold", "part").agg({"d": "min", "id": "count"}).collect()}
    last = {r["fold"]: r["max(d)"] for r in folds.members(placed, folds.fold_table(placed, "d", CONFIG), "d").where("part = 'train'").groupBy("fold").agg({"d": "max"}).collect()}
    for k in (1, 2):
        assert (spans[k, "validation"]["min(d)"] - last[k]).days >= 7


def test_stack_beats_the_constant_and_reloads(spark, rows):
    linear = {"linear": model.linear_member, "narrow": lambda f, y: model.linear_member(f[:1], y)}
    bundle = model.train(rows, ["a", "b", "c", "void"], "y", "d", "id", members=linear, candidates={"noise": lambda f, y: model.linear_member(f[1:2], y)}, config=CONFIG)
    assert bundle["gate"] and bundle["features"] == ["a", "b", "c"] and "noise" not in bundle["kept"]
    assert bundle["report"]["stack"]["log_loss"] < bundle["report"]["constant"]["log_loss"]
    path = tempfile.mkdtemp()
    model.save(bundle, path, "v1", spark)
    again = model.load(path, "v1", bundle["features"], spark)
    one = {r["id"]: r["raw"] for r in model.score(bundle, rows, "id").collect()}
    assert one == pytest.approx({r["id"]: r["raw"] for r in model.score(again, rows, "id").collect()})
    with pytest.raises(ContractError):
        model.load(path, "v2", bundle["features"], spark)


def test_too_few_rows(rows):
    with pytest.raises(ContractError, match="no fold"):
        model.out_of_fold(rows.limit(40), ["a"], "y", "d", "id", {"linear": model.linear_member}, CONFIG)


def test_boosting_stops_early(rows):
    rounds = {}
    model.out_of_fold(rows, ["a", "b"], "y", "d", "id", {"boosted": lambda f, y, rounds=None: model.boosted_member(f, y, rounds, 12)}, replace(CONFIG, folds=1), rounds)
    assert 1 <= rounds["boosted"][0] <= 12 and model.best_rounds([3, 9, 5]) == 5


def test_the_validation_slice_stops_the_boosting(spark, rows, tmp_path):
    """Held rows that agree with the rule let it grow, held rows that contradict it end it at once; nothing grows twice."""
    from pyspark.sql import functions as F

    part = rows.select("id", "a", "b", "y", (F.col("id") % 4 == 0).alias("_held"))
    against = part.withColumn("y", F.when(F.col("_held"), 1 - F.col("y")).otherwise(F.col("y")))
    fitted = {}
    for name, data in (("with", part), ("against", against)):
        member = model.BoostedTrees(["a", "b"], "y", most=40, patience=5)
        fitted[name] = member.fit(data)
        best, _ = model.best_round(member.losses, 5)
        assert model.rounds_of(fitted[name]) == best and len(member.losses) == min(best + 5, 40)
    assert model.rounds_of(fitted["against"]) == 1 < model.rounds_of(fitted["with"])
    # the ensemble that is cut back scores as its rounds did, and after a reload
    loss = model._scored(fitted["with"], part.where("_held"), ["y"], "p").agg(F.avg(F.when(F.col("y") == 1, -F.log("p")).otherwise(-F.log(1 - F.col("p"))))).first()[0]
    member = model.BoostedTrees(["a", "b"], "y", most=model.rounds_of(fitted["with"]), patience=5)
    member.fit(part)
    assert loss == pytest.approx(min(member.losses))
    fitted["with"].write().save(f"{tmp_path}/m")
    again = model.PipelineModel.load(f"{tmp_path}/m")
    score = lambda m: [r["p"] for r in model._scored(m, part, ["id"], "p").orderBy("id").collect()]
    assert score(again) == pytest.approx(score(fitted["with"]))


def test_chained_scores_equal_single_ones(spark, rows):
    fits = {"one": model.linear_member(["a", "b"], "y").fit(rows), "two": model.linear_member(["c"], "y").fit(rows)}
    got = {r["id"]: (r["one"], r["two"]) for r in model.chained(fits, rows, ["id"]).collect()}
    for k, name in enumerate(fits):
        assert {i: v[k] for i, v in got.items()} == pytest.approx({r["id"]: r[name] for r in model._scored(fits[name], rows, ["id"], name).collect()})


def test_a_failed_gate_is_registered_and_not_saved(spark, rows, tmp_path):
    """A member that knows nothing leaves the stack at the constant's loss: the run ends as rejected, without files."""
    from pyspark.sql import functions as F

    data = rows.withColumns({"one": F.lit(1.0), "g": F.col("id") % 3})
    config = replace(CONFIG, folds=1, train_start=date(2023, 1, 1), train_end=date(2024, 12, 31), min_coverage=0.5)
    empty = spark.createDataFrame([], "model_version string, trained_at string, train_range string, cv_log_loss double, cv_brier double, gates_passed boolean, gate_report string, status string")
    run = lambda features, path: model.train_candidate(data, features, "y", "d", "id", "g", empty, path, "v", "now", members={"linear": model.linear_member}, config=config)
    registered, bundle = run(["one"], f"{tmp_path}/bad")
    row = registered.first()
    assert not bundle["gate"] and (row["status"], row["gates_passed"]) == ("rejected", False) and row["gate_report"] and not (tmp_path / "bad").exists()
    with pytest.raises(ContractError):
        model.save(bundle, f"{tmp_path}/bad", "v", spark)
    registered, bundle = run(["a", "b"], f"{tmp_path}/good")
    row = registered.first()
    assert bundle["gate"] and (row["status"], row["gates_passed"]) == ("candidate", True)
    loaded = model.load(f"{tmp_path}/good", "v", bundle["features"], spark)
    assert loaded["intervals"].count() == bundle["intervals"].count() and loaded["rates"].count() == 3


def test_a_round_of_boosting_costs_a_job_a_level(spark, rows):
    """Rows are binned once, and dealt by their number: no round plans, scans or stores the rows anew."""
    from pyspark.sql import functions as F

    part = rows.select("a", "b", "y", (F.col("id") % 4 == 0).alias("_held")).repartition(16)
    assert model._dealt(part).rdd.getNumPartitions() == 1
    spark.sparkContext.setJobGroup("boosting", "20 rounds")
    try:
        member = model.BoostedTrees(["a", "b"], "y", most=20, patience=20)
        member.fit(part)
        assert len(member.losses) == 20 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) <= 20 * 7 + 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fits_read_their_rows_in_few_tasks(spark, rows, monkeypatch):
    """every step of a fit is a job, so rows lie in as many tasks as their number asks for, however they were dealt before."""
    assert [model.tasks_for(n) for n in (0, 1, model.TASK_ROWS, model.TASK_ROWS + 1)] == [1, 1, 1, 2] and model.tasks_for(150_000) == 1
    seen, settled = [], model.settled
    monkeypatch.setattr(model, "settled", lambda df: seen.append(settled(df)) or seen[-1])
    dealt = rows.repartition(16).select("id", "d", "y", "a", "b")
    model.linear_member(["a", "b"], "y").fit(dealt)
    assert [x.rdd.getNumPartitions() for x in seen] == [1]
    parts = []

    class Seeing(model.WeightedPenalty):
        def _fit(self, dataset):
            parts.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    def member(features, label):
        return model._prepared(features, Seeing(model.LogisticRegression(labelCol=label, featuresCol="_x"), 1.0))

    monkeypatch.setattr(model, "stage", lambda df, name: model.settled(df.repartition(16)))
    model.out_of_fold(dealt, ["a", "b"], "y", "d", "id", {"linear": member}, CONFIG)
    assert parts == [1, 1]


def test_a_stack_is_learnt_once(spark, rows, monkeypatch):
    """the stack of the members that stay is the one whose loss was taken, and is not learnt again."""
    names, stack = [], model.stack
    monkeypatch.setattr(model, "stack", lambda oof, label, members, least=50: names.append(tuple(members)) or stack(oof, label, members, least))
    known = model.evaluate(rows, ["a", "b"], "y", "d", "id", members={"linear": model.linear_member}, candidates={"noise": lambda f, y: model.linear_member(f[1:2], y)}, config=CONFIG)
    assert names == [("linear",), ("linear", "noise")] and known["kept"] == ["linear"]
    assert stack(known["oof"], "y", ["linear"]).stages[-1].coefficients.toArray() == pytest.approx(known["meta"].stages[-1].coefficients.toArray())
