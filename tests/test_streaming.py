"""Streams: quiet matchups expire, replays survive restarts, upserts touch their buckets."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources.tables import KeyedTable
from tidemark.streaming import snapshots

START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of event files; ``add`` writes rows (id, minutes after the start, matchup, book, value) as the next file."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    made = []

    def add(*rows):
        rows = [(i, START + timedelta(minutes=m), u, b, float(v), "{}") for i, m, u, b, v in rows]
        path = f"{tmp_path}/in/{len(made):03d}"
        made.append(path)
        spark.createDataFrame(rows, snapshots.EVENTS).coalesce(1).write.parquet(path)

    yield add, lambda: snapshots.events_stream(spark, f"{tmp_path}/in/*/*.parquet"), tmp_path
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def quotes(stream):
    return stream.select(F.col("user_id").alias("matchup"), F.col("event_type").alias("book"), "captured_at", F.col("value").alias("p"))


def test_a_quiet_matchup_expires(spark, feed):
    """Matchup 1 gets no more rows; only time passes, by rows of matchup 2, and its books leave one after another."""
    add, stream, at = feed
    add((1, 0, 1, "a", 0.4), (2, 4, 1, "b", 0.6))
    run = lambda: snapshots.replayed(snapshots.consensus_stream(quotes(stream()), 600.0, 2, "1 minute"), f"{at}/out", f"{at}/checkpoint", "update")

    def of(matchup):
        rows = run().where(F.col("matchup") == matchup).collect()
        r = max(rows, key=lambda r: (r["as_of"], r["batch"]))
        return r["books_n"], r["p_market"]

    assert of(1) == (2, 0.5)
    add((3, 10, 2, "a", 0.3), (4, 10, 2, "b", 0.5))  # the watermark is at 9 minutes
    assert of(1) == (2, 0.5) and of(2) == (2, 0.4)
    add((5, 12, 2, "a", 0.3))  # at 11: quote a of matchup 1 is over 10 minutes old
    assert of(1) == (1, None)
    add((6, 16, 2, "c", 0.9))  # at 15: so is quote b
    assert of(1) == (0, None) and of(2) == (3, 0.5)
    add((7, 17, 1, "b", 0.7), (8, 17, 1, "c", 0.9))  # it comes back with nothing of before
    assert of(1) == (2, 0.8)


def test_late_and_older_quotes_change_nothing(spark, feed):
    add, stream, at = feed
    add((1, 10, 1, "a", 0.4), (2, 10, 1, "b", 0.6))
    add((3, 8, 1, "a", 0.9), (4, 9, 1, "c", 0.8))  # older than a's quote; a book of its own
    rows = snapshots.replayed(snapshots.consensus_stream(quotes(stream()), 600.0, 2, "30 minutes"), f"{at}/out", f"{at}/checkpoint", "update").collect()
    last = max(rows, key=lambda r: (r["as_of"], r["batch"]))
    assert (last["books_n"], round(last["p_market"], 6)) == (3, 0.6)


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_replay_after_a_restart_has_all_batches(spark, feed, mode):
    add, stream, at = feed
    run = lambda: snapshots.replayed(stream().groupBy("user_id").count(), f"{at}/out", f"{at}/checkpoint", mode)
    assert run().count() == 0
    add((1, 0, 1, "a", 1), (2, 1, 2, "a", 1))
    assert sorted((r["user_id"], r["count"]) for r in run().collect()) == [(1, 1), (2, 1)]
    add((3, 2, 2, "b", 1))
    want = [(1, 1), (2, 1), (2, 2)] if mode == "update" else [(1, 1), (2, 2)]
    assert sorted((r["user_id"], r["count"]) for r in run().collect()) == want
    assert sorted((r["user_id"], r["count"]) for r in run().collect()) == want  # nothing new


def test_stream_upserts_touch_their_buckets(spark, feed):
    add, stream, at = feed
    table = KeyedTable(spark, f"{at}/table", ["user_id"], buckets=8)
    run = lambda: snapshots.upsert_stream(stream().select("user_id", "event_id", "captured_at"), table, "captured_at", f"{at}/checkpoint").awaitTermination()
    add(*[(i, i, i, "a", 1) for i in range(50)])
    run()
    before = table.manifest()["slots"]
    add((100, 90, 7, "a", 1), (101, 80, 7, "b", 1))
    run()
    after = table.manifest()["slots"]
    assert sum(before[s] != after[s] for s in after) == 1
    assert {r["user_id"]: r["event_id"] for r in table.read().collect()} == {i: i for i in range(50)} | {7: 100}
    add((102, 3, 7, "b", 1))  # older than what is stored
    run()
    assert table.read().where("user_id = 7").first()["event_id"] == 100


def test_the_state_is_asked_per_matchup_and_not_per_row():
    """A thousand rows of two books cost one read of the state and two writes; a stored newer quote stays, one too old leaves."""
    import pandas as pd

    from tidemark.streaming.snapshots import ConsensusProcessor

    class Books(dict):
        calls = 0

        def __getattribute__(self, name):
            if name in ("exists", "iterator", "containsKey", "getValue", "updateValue", "removeKey"):
                Books.calls += 1
            return super().__getattribute__(name)

        exists = dict.__len__
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

        def iterator(self):
            return iter(list(self.items()))

    class Handle(set):
        listTimers, registerTimer, deleteTimer = set.copy, set.add, set.remove

    class Time:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    processor = ConsensusProcessor(100.0, 2)
    processor.books, processor.handle = Books({("old",): (800.0, 0.9), ("b",): (1000.0, 0.4)}), Handle({900_001})
    rows = pd.DataFrame({"book": ["a", "b"] * 500, "at": [500.0 + i / 2 for i in range(1000)], "p": [0.2, 0.8] * 500})
    (got,) = processor.handleInputRows((7,), iter([rows[:600], rows[600:]]), Time)
    assert got.iloc[0].tolist() == [7, 1000.0, 2, pytest.approx(0.3)]
    assert dict(processor.books) == {("a",): (999.0, 0.2), ("b",): (1000.0, 0.4)} and set(processor.handle) == {1_099_001}
    assert Books.calls <= 6
