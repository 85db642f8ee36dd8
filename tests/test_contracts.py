"""Loads, readiness, registry and upserts fail closed."""

import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import registry
from tidemark.sources import io
from tidemark.specs import SPECS, create_table

SPEC = SPECS["pitcher_innings"]
ROW = {"pitcher_id": "7", "game_id": "g1", "game_date": "2024-05-01", "inning": "1", "first_inning_runs": "0", "first_inning_hits": "1", "first_inning_walks": "0"}


def frame(spark, *changes):
    rows = [ROW | c for c in changes]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in rows[0]))


def test_accepts_and_types(spark):
    out = quality.validate(frame(spark, {}, {"game_id": "g2"}), SPEC, " feed ")
    assert out.count() == 2 and dict(out.dtypes)["game_date"] == "date" and out.first()["source"] == "feed"
    assert out.columns[:-2] == sorted(out.columns[:-2])


@pytest.mark.parametrize(
    ("change", "message"),
    [({"inning": "one"}, "unreadable"), ({"game_date": "soon"}, "unreadable"), ({"game_id": None}, "null keys"), ({"note": "x"}, "unknown")],
)
def test_refuses(spark, change, message):
    with pytest.raises(io.ContractError, match=message):
        quality.validate(frame(spark, change), SPEC, "feed")


def test_refuses_more(spark):
    for rows, source, message in ((frame(spark, {}, {}), "feed", "repeated"), (frame(spark, {}), " ", "blank"), (frame(spark, {}).limit(0), "feed", "no rows"), (frame(spark, {}).drop("inning"), "feed", "missing")):
        with pytest.raises(io.ContractError, match=message):
            quality.validate(rows, SPEC, source)


def test_upsert_is_idempotent_and_partial(spark):
    path = f"{tempfile.mkdtemp()}/t"
    spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double").write.parquet(path)
    new = spark.createDataFrame([(2, 9.0), (3, 3.0)], "k int, x double")
    for _ in range(2):
        io.upsert(new, path, ["k"])
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, None, 3.0)]
    with pytest.raises(io.ContractError, match="null keys"):
        io.upsert(spark.createDataFrame([(None, 1.0)], "k int, x double"), path, ["k"])


def test_readers_refuse(spark):
    with pytest.raises(io.ContractError):
        io.read_dataset(spark, "/nowhere/x.xlsx")
    with pytest.raises(io.ContractError):
        io.bulk_read(spark, "/nowhere", "avro", "k int")
    with pytest.raises(io.ContractError):
        io.backfill(spark.range(1), None, "id", 2, 1)


def test_tables_of_every_spec(spark):
    for name, spec in SPECS.items():
        create_table(spark, spec, f"t_{name}")
        create_table(spark, spec, f"t_{name}")
        assert spark.table(f"t_{name}").columns == spec.schema.names


def test_registry(spark):
    rows = spark.createDataFrame(
        [("v1", "production", 1, True, True, None, "{}"), ("v2", "candidate", 2, True, True, False, None), ("v3", "candidate", 3, True, None, None, None)],
        "model_version string, status string, trained_at int, gates_passed boolean, holdout_passed boolean, holdout_burned_rerun boolean, gate_report string",
    )
    assert registry.require_current(rows) == "v1"
    after = {r["model_version"]: r for r in registry.promote(rows, "v2", "now").collect()}
    assert (after["v1"]["status"], after["v2"]["status"]) == ("retired", "production") and "now" in after["v2"]["gate_report"]
    for version in ("v1", "v3", "v9"):
        with pytest.raises(io.ContractError):
            registry.promote(rows, version, "now")
    with pytest.raises(io.ContractError):
        registry.require_current(rows.where("status = 'candidate'"))
    assert {r["holdout_passed"] for r in registry.record_holdout(rows, "v3", False).where("model_version = 'v3'").collect()} == {False}
    with pytest.raises(io.ContractError):
        registry.record_holdout(rows, "v2", True)


def test_target_rules(spark):
    df = spark.createDataFrame([(1, date(2024, 5, 1)), (1, date(2024, 5, 2))], "y int, d date")
    with pytest.raises(io.ContractError, match="1 classes"):
        quality.require_target(df, "y", "d", date(2024, 1, 1), date(2024, 6, 1), date(2025, 1, 1))
    with pytest.raises(io.ContractError, match="inverted"):
        quality.require_target(df, "y", "d", date(2024, 6, 1), date(2024, 1, 1), date(2025, 1, 1))
    with pytest.raises(io.ContractError, match="holdout"):
        quality.require_target(df, "y", "d", date(2024, 1, 1), date(2025, 6, 1), date(2025, 1, 1))
    quality.require_target(df.withColumn("y", F.when(F.dayofmonth("d") == 1, 0).otherwise(1)), "y", "d", date(2024, 1, 1), date(2024, 6, 1), date(2025, 1, 1))


def test_upsert_survives_a_crash_between_renames(spark, tmp_path):
    path = f"{tmp_path}/t"
    io.upsert(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double"), path, ["k"])
    swap = io.Swap(spark, path)
    spark.createDataFrame([(1, 1.0), (2, 9.0)], "k int, x double").write.parquet(f"{path}__new")
    swap._rename("", "__old")  # the job dies here
    io.upsert(spark.createDataFrame([(3, 3.0)], "k int, x double"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1.0), (2, 9.0), (3, 3.0)]
    assert not swap.exists("__old") and not swap.exists("__new")


def test_older_rows_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    io.upsert(spark.createDataFrame([(1, 5, "new")], "k int, at int, s string"), path, ["k"], newer="at")
    io.upsert(spark.createDataFrame([(1, 4, "old"), (2, 1, "b")], "k int, at int, s string"), path, ["k"], newer="at")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 5, "new"), (2, 1, "b")]


def test_holdout_is_opened_once(spark):
    rows = spark.createDataFrame([("v1", "candidate", True, '{"a":{"b":1},"n":2.5}'), ("bad", "rejected", False, None)], "model_version string, status string, gates_passed boolean, gate_report string")
    scored = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    contract = {"training_end": date(2024, 11, 30), "baseline_rate": 0.5}
    run = lambda r, v="v1", c=contract, **more: registry.evaluate_holdout(r, v, c, scored, "p", "y", "now", **more)
    after = run(rows).cache()
    row = after.where("model_version = 'v1'").first()
    assert (row["status"], row["holdout_passed"], row["holdout_n"], row["holdout_burned_rerun"]) == ("candidate", True, 4, False)
    assert row["holdout_brier"] == pytest.approx(0.025) and row["gate_report"].startswith('{"a":{"b":1},"n":2.5,"locked_holdout":{')
    with pytest.raises(io.ContractError, match="spent"):
        run(after)
    assert run(after, acknowledge_burn=True).where("model_version = 'v1'").first()["holdout_burned_rerun"]
    for version, change, message in (("none", {}, "registered"), ("bad", {}, "gates"), ("v1", {"training_end": date(2025, 3, 1)}, "overlaps"), ("v1", {"baseline_rate": 1.0}, "between")):
        with pytest.raises(io.ContractError, match=message):
            run(rows, version, contract | change)
