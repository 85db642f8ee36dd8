"""The registered queries of the stack, against figures that are computed here from their rows."""

import math
import os

import numpy as np
import pytest

from tidemark.plans import model, queries
from tidemark.plans.queries import QUERIES
from tidemark.plans.views import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def ask(spark):
    """Rows of a query, by name; the stacks are trained once."""
    known = {}

    def rows(name):
        if name not in known:
            known[name] = QUERIES[name](spark, FOLDER).collect()
        return known[name]

    yield rows
    queries._bundles.clear()


@pytest.fixture(scope="module")
def bundles(spark, ask):
    return {v: queries.bundle(Tables(spark, FOLDER), v) for v in queries.TARGETS}


def loss(p, y):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(np.mean(-(y * np.log(p) + (1 - y) * np.log(1 - p))))


def test_out_of_fold_rows_follow_the_folds(ask, bundles):
    """Rows are those of the validation slices, by position in (day, id), and scores are probabilities."""
    rows = sorted(((r["d"], r["rid"]) for r in bundles["order"]["rows"].collect() if r["d"] is not None and sum(r[c] is not None for c in queries.MODEL_FEATURES) >= 3))
    n = len(rows)
    fold_of = {rid: k for k in range(1, 6) for _, rid in rows[n * k // 6 : n * (k + 1) // 6]}
    got = {r["rid"]: r for r in ask("l05_out_of_fold")}
    folds = {r["fold"] for r in got.values()}
    assert {rid: r["fold"] for rid, r in got.items()} == {rid: k for rid, k in fold_of.items() if k in folds} and len(folds) >= 4
    for name, column in (("l01_boosted_member", "boosted"), ("l03_linear_member", "linear"), ("k01_pluggable_member", "forest")):
        assert {r["rid"]: r[column] for r in ask(name)} == {rid: r[column] for rid, r in got.items()}
        assert all(0 <= r[column] <= 1 for r in got.values()) and len({round(r[column], 6) for r in got.values()}) > 20


def test_stack_and_its_report(ask, bundles):
    """The stack is the logistic of its members' scores, and every figure is the mean over the rows."""
    oof = {r["rid"]: r for r in ask("l05_out_of_fold")}
    stack = {r["rid"]: r for r in ask("l06_stack")}
    meta = bundles["order"]["meta"].stages[-1]
    members = bundles["order"]["kept"]
    for rid, r in stack.items():
        z = meta.intercept + sum(c * oof[rid][m] for c, m in zip(meta.coefficients, members))
        assert r["stack"] == pytest.approx(1 / (1 + math.exp(-z)))
    y = np.array([r["label"] for r in stack.values()], float)
    want = {m: np.array([oof[rid][m] for rid in stack]) for m in ("boosted", "linear", "forest")} | {"stack": np.array([r["stack"] for r in stack.values()]), "constant": np.full(len(y), y.mean())}
    report = {r["member"]: r for r in ask("l07_stack_report")}
    assert set(report) == set(want)
    for m, p in want.items():
        assert (report[m]["log_loss"], report[m]["brier"], report[m]["n"]) == (pytest.approx(loss(p, y)), pytest.approx(float(np.mean((p - y) ** 2))), len(y))


def test_optional_member_and_refit(ask, bundles):
    """The gain is that of a stack with the member over one without; L02: the refit has the median of the folds' rounds."""
    (row,) = ask("l04_optional_member")
    b = bundles["order"]
    oof = b["oof"]
    loss_of = lambda names: model._scored(model.stack(oof, "y_order", names), oof, ["y_order"], "p").toPandas().pipe(lambda d: loss(d["p"].to_numpy(), d["y_order"].to_numpy(float)))
    assert row["member"] == "forest" and row["gain"] == pytest.approx(loss_of(["boosted", "linear"]) - loss_of(["boosted", "linear", "forest"]), abs=1e-9)
    assert row["kept"] == (row["gain"] >= 0.005) == ("forest" in b["kept"])
    (fit,) = ask("l02_full_refit")
    assert fit["trees"] == fit["median_rounds"] == int(np.median(b["rounds"]["boosted"])) and fit["default_rounds"] == 200
    assert len(b["rounds"]["boosted"]) == len({r["fold"] for r in ask("l05_out_of_fold")})


def isotonic(points):
    """Isotonic fit of (score, label) by pooling."""
    blocks = []
    for s, y in sorted(points):
        blocks.append([1, y, [s]])
        while len(blocks) > 1 and (blocks[-2][2][-1] == blocks[-1][2][0] or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]):
            n, t, ss = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + t, blocks[-1][2] + ss]
    return {s: t / n for n, t, ss in blocks for s in ss}


def test_scoring_is_calibrated_by_out_of_fold_scores(ask, bundles):
    """A score's interval is that of two isotonic fits with the score itself added under either label."""
    pairs = [(r["stack"], r["y_rule"]) for r in bundles["rule"]["oof"].collect()]
    rows = ask("l10_scoring")
    assert len(rows) == bundles["rule"]["rows"].count() and all(r["valid"] for r in rows)
    for r in sorted(rows, key=lambda r: r["raw"])[::150]:
        p0, p1 = (isotonic([*pairs, (r["raw"], y)])[r["raw"]] for y in (0, 1))
        assert r["p_cal"] == pytest.approx(p1 / (1 - p0 + p1))
    truth = {r["rid"]: r["y_rule"] for r in bundles["rule"]["rows"].collect()}
    assert np.mean([(r["p_cal"] > 0.5) == truth[r["rid"]] for r in rows]) > 0.95


def test_training_runs_are_registered_by_their_gate(ask, bundles):
    """Status, figures and files follow the gate; what was saved scores as it did."""
    runs = {r["model_version"]: r for r in ask("n05_train_candidate")}
    for r in ask("l11_save_load"):
        b, run = bundles[r["model_version"]], runs[r["model_version"]]
        figures = b["report"]
        assert b["gate"] == r["gate"] == run["gates_passed"] == (figures["stack"]["log_loss"] < figures["constant"]["log_loss"])
        assert run["status"] == ("candidate" if b["gate"] else "rejected") and run["reported"] and {"boosted", "linear"} <= set(r["members"].split(","))
        assert run["cv_log_loss"] == pytest.approx(figures["stack"]["log_loss"], abs=1e-6)
        assert (r["largest_difference"], r["refused"]) == ((0.0, None) if b["gate"] else (None, True))
    assert runs["rule"]["gates_passed"]


def test_a_slate_from_end_to_end(ask, bundles):
    """Every order once; status, shrinkage, edge and tier by their definitions."""
    b = bundles["rule"]
    rows = {r["rid"]: r for r in ask("n03_slate_end_to_end")}
    given = {r["rid"]: r for r in b["rows"].collect()}
    rates = {str(r["venue_id"]): r["rate"] for r in b["rates"].collect()}
    scored = {r["rid"]: r for r in ask("l10_scoring")}
    assert set(rows) == set(given)
    seen = set()
    for rid, r in rows.items():
        g = given[rid]
        seen.add(r["status"])
        if g["coverage"] < 0.3:
            assert (r["status"], r["reason"], r["raw"], r["p_final"], r["edge"], r["tier"]) == ("BLOCKED", f"coverage_{g['coverage']:.2f}_below_0.30", None, None, None, "LOW")
            continue
        p, rate = scored[rid]["p_cal"], rates.get(str(g["venue_id"]))
        n = min(min(g["away_n"], g["home_n"]), 60) * g["coverage"]
        want = p if rate is None else (n * p + 20 * rate) / (n + 20)
        assert (r["raw"], r["p_cal"], r["p_final"]) == (pytest.approx(scored[rid]["raw"]), pytest.approx(p), pytest.approx(want))
        if r["status"] == "OK":
            assert r["edge"] == pytest.approx(r["p_final"] - r["p_market"]) and r["books_n"] >= 2 and 0 <= r["age_s"] <= 43200
            assert r["tier"] == ("HIGH" if rid % 2 == 0 and g["coverage"] >= 0.95 else "MEDIUM")
        else:
            assert r["status"] == "DEGRADED" and r["edge"] is None and r["tier"] == "LOW" and r["reason"].split("_")[0] in ("no", "books", "odds")
    assert {"BLOCKED", "DEGRADED"} <= seen


def test_a_query_learns_what_it_returns(spark, ask, bundles, monkeypatch):
    """L01 and L03 learn their member over the folds and score as the whole stack does; L05 then learns only what is missing."""
    want = {name: {r["rid"]: r[column] for r in ask(name)} for name, column in (("l03_linear_member", "linear"), ("l01_boosted_member", "boosted"))}
    counts: dict[str, int] = {}

    def counted(name, make):
        def member(*a, **b):
            counts[name] = counts.get(name, 0) + 1
            return make(*a, **b)

        return member

    every = {"boosted": counted("boosted", model.boosted_member), "linear": counted("linear", model.linear_member)}
    monkeypatch.setattr(model, "MEMBERS", every)
    monkeypatch.setattr(model, "forest_member", counted("forest", model.forest_member))
    kept = dict(queries._bundles)
    for key in [k for k in kept if k[-1] != "slate"]:
        del queries._bundles[key]
    try:
        n = len({r["fold"] for r in ask("l05_out_of_fold")})
        assert {r["rid"]: r["linear"] for r in QUERIES["l03_linear_member"](spark, FOLDER).collect()} == pytest.approx(want["l03_linear_member"])
        assert counts == {"linear": n}
        QUERIES["l01_boosted_member"](spark, FOLDER).collect()
        assert counts == {"linear": n, "boosted": n}
        QUERIES["l05_out_of_fold"](spark, FOLDER).collect()
        assert counts == {"linear": n, "boosted": n, "forest": n}
    finally:
        queries._bundles.clear()
        queries._bundles.update(kept)


def test_models_learn_from_a_slate_without_what_they_do_not_read(spark, monkeypatch):
    """The models' slate has the whole slate's values and reads no lineup, no last starts and no other frames."""
    from tidemark.operators import features

    t = Tables(spark, FOLDER)
    whole = {r["rid"]: r.asDict() for r in queries.slate(t).collect()}

    def refused(*a, **b):
        raise AssertionError("not asked for")

    for name in ("top_members_means", "LastRows"):
        monkeypatch.setattr(features, name, refused)
    slim = {r["rid"]: r.asDict() for r in queries.slate(t, whole=False).collect()}
    assert {rid: {c: v for c, v in r.items() if c != "coverage"} for rid, r in whole.items()} == slim
    assert all(any(r[c] is not None for r in slim.values()) for c in queries.MODEL_FEATURES)


def test_folds_are_surveyed_in_one_pass(spark, monkeypatch):
    """Features that a fold's training rows lack are left out there, and parts with one class are refused, by one job for all folds."""
    from datetime import date, timedelta

    from tidemark.config import DEFAULT

    def per_fold(*a):
        raise AssertionError("a job per fold")

    monkeypatch.setattr(model, "observed", per_fold)
    seen = []

    def member(names, label):
        seen.append(tuple(names))
        return model.linear_member(names, label)

    def run(late, label):
        rows = [(i, date(2020, 1, 1) + timedelta(days=i), label(i), float(i % 7), 1.0 * (i % 3) if i >= late else None) for i in range(1200)]
        df = spark.createDataFrame(rows, "rid int, d date, y int, a double, b double")
        return model.out_of_fold(df, ["a", "b"], "y", "d", "rid", {"linear": member}, DEFAULT)

    out = run(400, lambda i: i % 2)
    assert out.count() == 800 and sorted(seen) == sorted([("a",)] + [("a", "b")] * 3)
    with pytest.raises(model.ContractError, match="fold 2: its training rows have one class only"):
        run(0, lambda i: int(i >= 400))


def test_fits_at_once_keep_their_own_properties(spark):
    """fits run beside each other, and none sees what Spark notes of another's query."""
    from threading import Barrier

    meet, context = Barrier(4, timeout=60), spark.sparkContext

    def work(i):
        context.setLocalProperty("tidemark.test", str(i))
        meet.wait()
        got = context.getLocalProperty("tidemark.test")
        meet.wait()
        return got

    assert model.at_once(spark, work, range(4)) == ["0", "1", "2", "3"]
