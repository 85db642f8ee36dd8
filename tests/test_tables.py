"""Keyed tables: upserts commit at once, survive crashes, meet other writers, and touch only their slots."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.sources import io
from tidemark.sources.tables import Conflict, KeyedTable

SCHEMA = "k int, p string, x double"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def partitioned(spark, path):
    table = KeyedTable(spark, str(path), ["k", "p"], ["p"])
    table.upsert(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], SCHEMA))
    return table


def test_upsert_touches_its_partitions_only(spark, tmp_path):
    table = partitioned(spark, tmp_path / "t")
    before = table.manifest()["slots"]
    for version in (2, 3):
        assert table.upsert(spark.createDataFrame([(2, "a", 9.0), (4, "a", 4.0)], SCHEMA)) == version
    after = table.manifest()["slots"]
    assert len(after) == 2 and len(set(before.items()) & set(after.items())) == 1
    assert rows_of(table.read(), "k", "p", "x") == [(1, "a", 1.0), (2, "a", 9.0), (3, "b", 3.0), (4, "a", 4.0)]
    assert rows_of(table.read(version=1), "k", "x") == [(1, 1.0), (2, 2.0), (3, 3.0)]
    only = table.read(spark.createDataFrame([("b",)], "p string"))
    assert rows_of(only, "k") == [(3,)] and len(only.inputFiles()) < len(table.read().inputFiles())


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path):
    """The committer dies with the new partition written: the old rows are all there, and the next upsert works."""
    table = partitioned(spark, tmp_path / "t")
    new = spark.createDataFrame([(1, "a", 7.0)], SCHEMA)

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.upsert(new, before_publish=die)
    again = KeyedTable(spark, str(tmp_path / "t"))
    assert rows_of(again.read(), "k", "x") == [(1, 1.0), (2, 2.0), (3, 3.0)]
    again.upsert(new)
    assert rows_of(again.read(), "k", "x") == [(1, 7.0), (2, 2.0), (3, 3.0)]
    assert again.vacuum(keep=1) >= 1 and rows_of(again.read(), "k", "x") == [(1, 7.0), (2, 2.0), (3, 3.0)] and again.versions() == [2]


@pytest.mark.parametrize(("mine", "theirs"), [((4, "a", 4.0), (5, "a", 5.0)), ((4, "a", 4.0), (5, "b", 5.0)), ((4, "a", 4.0), (4, "a", 5.0))])
def test_two_writers_lose_nothing(spark, tmp_path, mine, theirs):
    """Another writer publishes between this one's merge and its commit, in the same slot and in another."""
    table, waits = partitioned(spark, tmp_path / "t"), [True]

    def other():
        if waits:
            waits.pop()
            KeyedTable(spark, str(tmp_path / "t")).upsert(spark.createDataFrame([theirs], SCHEMA))

    assert table.upsert(spark.createDataFrame([mine], SCHEMA), before_publish=other) == 3
    want = {1: 1.0, 2: 2.0, 3: 3.0} | {theirs[0]: theirs[2]} | {mine[0]: mine[2]}
    assert dict(rows_of(table.read(), "k", "x")) == want

    def always():
        KeyedTable(spark, str(tmp_path / "t")).upsert(spark.createDataFrame([(9, "a", 0.0)], SCHEMA))

    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([mine], SCHEMA), tries=2, before_publish=always)


def test_names_are_taken_once(spark, tmp_path):
    folder = partitioned(spark, tmp_path / "t").folder
    assert folder.publish("manifests/x.json", "one") and not folder.publish("manifests/x.json", "two")
    assert folder.read("manifests/x.json") == "one" and [n for n in folder.names("manifests") if n.startswith("x")] == ["x.json"]


def test_new_columns_are_read_back(spark, tmp_path):
    table = partitioned(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([(2, "a", "note")], "k int, p string, extra string"))
    assert rows_of(table.read(), "k", "x", "extra") == [(1, 1.0, None), (2, 2.0, "note"), (3, 3.0, None)]
    table.upsert(spark.createDataFrame([(3, "b", 8.0)], SCHEMA))
    assert rows_of(table.read(), "k", "x", "extra") == [(1, 1.0, None), (2, 2.0, "note"), (3, 8.0, None)]


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    table.upsert(spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit(0.0).alias("x")))
    before = table.manifest()["slots"]
    table.upsert(spark.createDataFrame([(77, 1.0)], "k int, x double"))
    after = table.manifest()["slots"]
    assert len(before) == 16 and sum(before[s] != after[s] for s in before) == 1
    assert table.read().count() == 1000 and rows_of(table.read().where("x > 0"), "k") == [(77,)]
    part = table.read(spark.createDataFrame([(77,)], "k int"))
    assert part.count() < 200 and part.where("k = 77").count() == 1


def test_layouts_and_keys_are_checked(spark, tmp_path):
    table = partitioned(spark, tmp_path / "t")
    for keys, parts, buckets in ((["k"], [], 4), (["k", "p"], [], 4), (["p"], ["k"], 0), (["k", "p"], ["p"], 2)):
        with pytest.raises(io.ContractError):
            KeyedTable(spark, str(tmp_path / "t"), keys, parts, buckets)
    with pytest.raises(io.ContractError):
        KeyedTable(spark, str(tmp_path / "none"))
    for bad in ([(None, "a", 1.0)], [(1, "a", 1.0), (1, "a", 2.0)]):
        with pytest.raises(io.ContractError):
            table.upsert(spark.createDataFrame(bad, SCHEMA))
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == 1  # nothing to do, no new version
    newer = spark.createDataFrame([(1, "a", 0.5), (2, "a", 6.0)], SCHEMA)
    table.upsert(newer, newer="x")
    assert rows_of(table.read(), "k", "x") == [(1, 1.0), (2, 6.0), (3, 3.0)]


def test_backfill_keeps_rows_that_the_source_lacks(spark, tmp_path):
    schema = "g int, d date, x double"
    table = KeyedTable(spark, str(tmp_path / "t"), ["g", "d"], ["d"])
    day = lambda n: date(2024, 5, n)
    table.upsert(spark.createDataFrame([(1, day(1), 1.0), (2, day(1), 2.0), (3, day(2), 3.0), (4, day(3), 4.0)], schema))
    before = table.manifest()["slots"]
    source = spark.createDataFrame([(1, day(1), 10.0), (5, day(2), 5.0), (4, day(3), 40.0)], schema)
    assert io.backfill(source, table, "d", day(1), day(2)) == 2
    assert rows_of(table.read(), "g", "x") == [(1, 10.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)]
    assert len(set(before.items()) & set(table.manifest()["slots"].items())) == 1
    assert io.backfill(source, table, "d", day(8), day(9)) is None
    with pytest.raises(io.ContractError):
        io.backfill(source, table, "g", 1, 2)
