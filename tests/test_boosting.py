"""Boosted trees: those of Spark ML, grown in one stage."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.plans import model, queries
from tidemark.sources.io import ContractError

WHOLE = boosting.Settings(6, sample=1.0, columns=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(3000):
        a, b, c = rng.normal(), float(rng.integers(0, 4)), rng.normal()
        y = int(rng.random() < 1 / (1 + np.exp(-2 * a * (b - 1))))
        out.append((i, y, a if rng.random() < 0.9 else None, b, float("nan") if rng.random() < 0.05 else c, None if i % 2 else 1.5))
    return spark.createDataFrame(out, "id int, y int, a double, b double, c double, d double").withColumn("_held", F.col("id") % 5 == 0).cache()


def grown(rows, settings, tasks=1, parts=1):
    features = ["a", "b", "c", "d"]
    ready = model._prepared(features).fit(rows.where("NOT _held"))
    known = ready.stages[1].surrogateDF.first().asDict()
    names = [[f"_{kind}_{c}" for c in features] for kind in "im"]
    return boosting.grow(ready.transform(rows).repartition(parts), *names, [known[f"_d_{c}"] for c in features], "y", lambda n: tasks, settings)


def test_trees_are_those_of_spark(spark, rows):
    """Without draws of rows and columns: the same splits, scores and losses as ``GBTClassifier``, which is not told of held rows."""
    trees, losses = grown(rows, WHOLE)
    ready = model._prepared(["a", "b", "c", "d"]).fit(rows.where("NOT _held"))
    want = GBTClassifier(labelCol="y", featuresCol="_x", stepSize=0.05, maxDepth=6, maxIter=6, seed=1).fit(ready.transform(rows.where("NOT _held")))
    have = model._ensemble(spark, trees, 0.05, 8)
    score = lambda m, name: m.transform(ready.transform(rows)).select("id", model.vector_to_array("probability")[1].alias(name))
    both = score(want, "p").join(score(have, "q"), "id").select("p", "q").toPandas()
    # Spark may choose another of two equally good splits, so that a few held rows part ways
    assert np.mean(np.abs(both["p"] - both["q"]) < 1e-9) > 0.97
    held = ready.transform(rows.where("_held"))
    assert losses == pytest.approx([x / 2 for x in have.evaluateEachIteration(held.withColumn("label", F.col("y")))])
    assert losses == pytest.approx([x / 2 for x in want.evaluateEachIteration(held)], rel=2e-3)
    assert [t.numNodes for t in have.trees] == [len(t.rows) for t in trees]
    assert have.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.01)


def test_tasks_that_share_rows_grow_the_trees_of_one(spark, rows):
    """F1 to F8: rows of several tasks stay there, and only histograms meet; the trees are those that one task grows."""
    alone, losses = grown(rows, WHOLE)
    shared, losses_shared = grown(rows, WHOLE, tasks=3, parts=7)
    assert vars(shared[0]) == vars(alone[0])  # its gradients are whole numbers; later sums round, and may part ties otherwise
    assert [t.rows[:7] for t in shared] == [t.rows[:7] for t in alone] and losses_shared == pytest.approx(losses, rel=1e-3)


def test_rounds_cost_no_jobs(spark, rows):
    """F1 to F8: ten times the rounds are as many jobs; before, each level of a tree was one."""
    counts = []
    for most in (3, 30):
        spark.sparkContext.setJobGroup(f"rounds-{most}", "boosting")
        try:
            member = model.BoostedTrees(["a", "b"], "y", most=most, patience=50)
            assert model.rounds_of(member.fit(rows)) <= most == len(member.losses)
            counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{most}")))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_splits_follow_the_rows():
    """Few values are parted at every midpoint, many at even strides of rows, and a value of most rows takes one bin."""
    assert boosting.splits_of(np.array([1.0, 2.0, 4.0]), np.ones(3)).tolist() == [1.5, 3.0]
    assert boosting.splits_of(np.array([1.0]), np.ones(1)).tolist() == []
    many = boosting.splits_of(np.arange(3200.0), np.ones(3200))
    assert len(many) == 31 and np.abs(np.diff(many) - 100).max() <= 1
    heavy = boosting.splits_of(np.arange(100.0), np.where(np.arange(100) == 50, 10_000, 1.0))
    assert 49.5 in heavy or 50.5 in heavy
    values, counts = boosting.merged(np.repeat(np.arange(1000.0), 2), np.ones(2000), 10)
    assert len(values) == 10 and counts.sum() == 2000 and values[-1] == 999


def test_a_label_that_is_no_class_is_refused(rows):
    with pytest.raises(ContractError, match="label other than 0 and 1"):
        grown(rows.withColumn("y", F.when(F.col("id") == 7, 2).otherwise(F.col("y"))), WHOLE)


def test_the_rule_is_boosted_without_a_cut():
    """the rule's member boosts as long as held rows gain, as every boosted member does; before, 12 rounds at most."""
    member = queries.members("rule")["members"]["boosted"](["a"], "y")
    assert (member.most, member.patience) == (model.MOST_ROUNDS, model.PATIENCE) == (1000, 50)


def test_rows_that_are_alike_end_a_tree(spark):
    """A rule is learnt by the splits that it needs: what is left is rounding, and no tree splits on it."""
    data = spark.createDataFrame([(i, int(i % 10 < 3), float(i % 10), float(i % 7)) for i in range(2000)], "id int, y int, a double, b double").withColumn("_held", F.col("id") % 4 == 0)
    member = model.BoostedTrees(["a", "b"], "y", most=60, patience=50)
    fitted = member.fit(data)
    assert len(member.losses) == 60 and member.losses == sorted(member.losses, reverse=True)
    assert {t.numNodes for t in fitted.stages[-1].trees} <= {1, 3}
