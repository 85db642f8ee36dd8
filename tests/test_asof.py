"""As-of features on literal rows, and the rule that nothing of the day or later leaks in."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A

GAMES = [
    (1, date(2024, 5, 1), "a", 2.0, 6.0), (1, date(2024, 5, 7), "b", 4.0, 5.0), (1, date(2024, 5, 13), "c", 1.0, 7.0),
]


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(GAMES, "k int, d date, g string, er double, ip double")


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([("r", 1, date(2024, 5, 20)), ("none", 2, date(2024, 5, 20)), ("null", None, date(2024, 5, 20))], "rid string, k int, d date")


def test_ratio_of_sums_and_windows(games, requests):
    f = A.asof(games, requests, "k", "d", ["er", "ip"], (7, 365))
    f = f.select("rid", A.ratio(F.col("all_er"), F.col("all_ip"), 9.0).alias("era"), "7d_rows", "365d_rows", F.datediff("d", "prev_day").alias("rest"))
    rows = {r["rid"]: r for r in f.collect()}
    assert rows["r"]["era"] == pytest.approx(3.5)
    assert (rows["r"]["7d_rows"], rows["r"]["365d_rows"], rows["r"]["rest"]) == (1, 3, 7)
    assert rows["none"]["era"] is None and rows["none"]["365d_rows"] is None
    assert rows["null"]["era"] is None


def test_same_day_and_future_rows_change_nothing(spark, games, requests):
    leak = spark.createDataFrame([(1, date(2024, 5, 20), "x", 99.0, 1.0), (1, date(2024, 6, 1), "y", 99.0, 1.0)], games.schema)
    one = A.asof(games, requests, "k", "d", ["er", "ip"], (7, 30)).orderBy("rid").collect()
    two = A.asof(games.union(leak), requests, "k", "d", ["er", "ip"], (7, 30)).orderBy("rid").collect()
    assert one == two


def test_last_rows(games, requests):
    f = A.last_n(games, requests, "k", "d", "g", ["er"], 2).select("rid", "last_rows", "last_er", "last_er_n")
    rows = {r["rid"]: tuple(r)[1:] for r in f.collect()}
    assert rows == {"r": (2, 5.0, 2), "none": (None, None, None), "null": (None, None, None)}


def test_observed_counts_skip_nulls(spark, requests):
    h = spark.createDataFrame([(1, date(2024, 5, 1), 0.0), (1, date(2024, 5, 2), None), (1, date(2024, 5, 3), 2.0)], "k int, d date, x double")
    r = A.asof(h, requests, "k", "d", ["x"]).where("rid = 'r'").select("all_rows", "all_x_n", A.per_observation(F.col("all_x"), F.col("all_x_n")).alias("m")).first()
    assert tuple(r) == (3, 2, 1.0)


def test_top_members_need_all_three(spark):
    h = spark.createDataFrame([(i, date(2024, 5, 1), float(i), 2.0) for i in (1, 2, 3)], "b int, d date, n double, m double")
    lineups = spark.createDataFrame([("a", date(2024, 5, 2), [1, 2, 3, 4]), ("b", date(2024, 5, 2), [1, 2, 9]), ("c", date(2024, 5, 2), [])], "rid string, d date, ids array<int>")
    rows = {r["rid"]: r["top_mean"] for r in A.top_members_mean(h, lineups, "rid", "ids", "d", "b", "d", "n", "m", 30).collect()}
    assert rows["a"] == pytest.approx(1.0) and rows["b"] is None and rows["c"] is None


DAY = date(2024, 1, 1)


def history_of(spark, rows):
    return spark.createDataFrame([(1, date(*d), x) for d, x in rows], "k int, d date, x double")


@pytest.mark.parametrize(
    ("early", "week", "all_"),
    [(float("nan"), (3.0, 2), (3.0, 2)), (1e17, (3.0, 2), (1e17 + 3.0, 3)), (float("inf"), (3.0, 2), (math.inf, 3)), (float("-inf"), (3.0, 2), (-math.inf, 3)), (1e-12, (3.0, 2), (3.0 + 1e-12, 3)), (-3e28, (3.0, 2), (-3e28, 3))],
)
def test_old_values_leave_no_trace(spark, early, week, all_):
    """A NaN, infinite, huge or tiny value long before a frame changes nothing in it."""
    h = history_of(spark, [((2024, 1, 1), early), ((2024, 3, 1), 1.0), ((2024, 3, 2), 2.0)])
    ask = spark.createDataFrame([(1, date(2024, 3, 5))], "k int, d date")
    r = A.asof(h, ask, "k", "d", ["x"], (7, 365)).first()
    assert (r["7d_x"], r["7d_x_n"], r["7d_rows"]) == (*week, 2)
    assert (r["all_x"], r["all_x_n"], r["all_rows"]) == (*all_, 3) and r["365d_x"] == r["all_x"]
    last = A.last_n(h.withColumn("t", F.lit("t")), ask, "k", "d", "t", ["x"], 2).first()
    assert (last["last_x"], last["last_x_n"], last["last_rows"]) == (3.0, 2, 2)


def test_both_infinities_make_nan(spark):
    h = history_of(spark, [((2024, 3, 1), math.inf), ((2024, 3, 2), -math.inf), ((2024, 3, 3), 5.0)])
    ask = spark.createDataFrame([(1, date(2024, 3, 4)), (1, date(2024, 3, 3))], "k int, d date")
    rows = sorted(A.asof(h, ask, "k", "d", ["x"], (1, 2)).collect(), key=lambda r: r["d"])
    assert math.isnan(rows[1]["all_x"]) and rows[1]["1d_x"] == 5.0 and rows[1]["2d_x"] == -math.inf and math.isnan(rows[0]["2d_x"])


def slow_frames(rows, key, day, frames):
    """Every frame by its definition, summed exactly."""
    out = []
    for n in frames:
        got = [x for k, d, _, x in rows if k == key and d is not None and d < day and (n is None or d >= day - timedelta(n))] if key is not None and day is not None else []
        seen = [x for x in got if x is not None and not math.isnan(x)]
        out.append((len(got) or None, math.fsum(seen) if got else None, len(seen) or None))
    return out


@pytest.mark.parametrize("hot_rows", [0, 7, 1_000_000])
def test_frames_against_their_definition(spark, hot_rows):
    """Random rows with one key in a third of them, null keys, days and values, ties and repeated requests."""
    rng = random.Random(5)
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None])
    value = lambda: rng.choice([None, float("nan"), 1e15, 0.1, -2.5, rng.random() * 1e6, 1e-9])
    day = lambda: rng.choice([None, *[DAY + timedelta(rng.randrange(60)) for _ in range(9)]])
    rows = [(key(), day(), i, value()) for i in range(400)]
    asked = [(i, key(), day()) for i in range(250)]
    h = spark.createDataFrame(rows, "k int, d date, t int, x double")
    ask = spark.createDataFrame(asked + asked[:40], "rid int, kk int, dd date")  # some requests twice
    frames = {"3d": 3, "20d": 20, "all": None}
    same = lambda x, y: x is y is None or None not in (x, y) and math.isclose(x, y, rel_tol=1e-14, abs_tol=1e-20)
    close = lambda a, b: all((n, c) == (m, e) and same(x, y) for (n, x, c), (m, y, e) in zip(a, b, strict=True))

    got = A.asof(h, ask, "k", "d", ["x"], (3, 20), True, "kk", "dd", hot_rows).collect()
    assert sorted(r["rid"] for r in got) == sorted([*range(250), *range(40)])
    for r in got:
        _, k, d = asked[r["rid"]]
        assert (r["kk"], r["dd"]) == (k, d)
        assert close([(r[f"{w}_rows"], r[f"{w}_x"], r[f"{w}_x_n"]) for w in frames], slow_frames(rows, k, d, frames.values()))
    for n in (1, 4):
        got = A.last_n(h, ask, "k", "d", "t", ["x"], n, "kk", "dd", hot_rows).collect()
        assert len(got) == 290
        for r in got:
            _, k, d = asked[r["rid"]]
            mine = sorted((x for x in rows if x[0] == k and x[1] is not None and x[1] < d), key=lambda x: (x[1], x[2]))[-n:] if k is not None and d is not None else []
            seen = [x for *_, x in mine if x is not None and not math.isnan(x)]
            assert close([(r["last_rows"], r["last_x"], r["last_x_n"])], [(len(mine) or None, math.fsum(seen) if mine else None, len(seen) or None)])


def test_hot_key_takes_many_tasks(spark):
    """One key with a third of all requests is dealt over many tasks."""
    h = spark.range(3000).select((F.col("id") % 3).alias("k"), F.expr("date_add(DATE'2024-01-01', CAST(id % 50 AS INT))").alias("d"), F.lit(1.0).alias("x"), "id")
    ask = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(DAY + timedelta(40)).alias("d"))
    found = A._before(ask, "k", "d", [A.History(h, "k", "d", ["x"], (7,))], 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        per_task = found.where("_asked.k = 0 AND `_at__0`.rows > 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in per_task) == 1000 and len(per_task) == 4  # all of the test session's shuffle partitions
    salts, hot = A._dealt(A._marked(ask, "k", "d"), 50)
    assert [tuple(r) for r in hot.collect()] == [(0, 20)] and max(r["count"] for r in salts.groupBy("_k", "_salt").count().collect()) < 90


def test_whole_numbers_and_words_of_any_name(spark):
    h = spark.createDataFrame([(1, DAY, 2**30, True), (1, DAY + timedelta(1), 2**30, None), (1, DAY + timedelta(2), 5, False)], "k int, d date, `a b` int, _x0 boolean")
    ask = spark.createDataFrame([(1, DAY + timedelta(3), "s")], "k int, d date, _salt string")
    r = A.asof(h.withColumn("_x0", F.col("_x0").cast("int")), ask, "k", "d", ["a b", "_x0"], (1,)).first()
    assert (r["all_a b"], r["all__x0"], r["all__x0_n"], r["1d_a b"], r["_salt"]) == (2.0**31 + 5, 1.0, 2, 5.0, "s")


def test_stored_state_equals_a_full_build(spark, tmp_path):
    """Built from a part, extended by days, a day replaced and old days corrected: always what the full history gives."""
    from tidemark.operators.feature_state import FeatureState

    rng = random.Random(6)
    value = lambda: rng.choice([None, float("nan"), 1e17, 0.1, -2.5, rng.random()])
    rows = [(rng.choice([1, 1, 2, 3, None]), DAY + timedelta(rng.randrange(200)), value(), rng.randrange(9)) for _ in range(500)]
    schema = "k int, d date, x double, n int"
    ask = spark.createDataFrame([(i, rng.choice([1, 2, 3, 4, None]), rng.choice([None, *[DAY + timedelta(rng.randrange(-5, 300)) for _ in range(9)]])) for i in range(120)] * 2, "rid int, k int, d date")
    of = lambda some: A.History(spark.createDataFrame(some, schema), "k", "d", ["x", "n"], (7, 45, 365), True, "h_")
    state = FeatureState(spark, f"{tmp_path}/state", of(rows[:1]))

    def check(some):
        plain = lambda df: sorted((str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect()))
        assert plain(state.read(ask, "k", "d")) == plain(A.asof_many(ask, "k", "d", [of(some)]))

    with pytest.raises(Exception, match="empty"):
        state.read(ask, "k", "d")
    split = DAY + timedelta(120)
    early, late = [r for r in rows if r[1] < split], [r for r in rows if r[1] >= split]
    state.extend(spark.createDataFrame(early, schema))
    check(early)
    for _ in range(2):  # again: nothing changes
        state.extend(spark.createDataFrame(late, schema))
    check(rows)
    day = min(r[1] for r in rows)
    mended = [(k, d, 50.0, 1) if d == day else (k, d, x, n) for k, d, x, n in rows]
    state.extend(spark.createDataFrame([r for r in mended if r[1] == day], schema))
    check(mended)


def test_a_slate_reads_the_slices_of_its_frames(spark, tmp_path):
    from tidemark.operators.feature_state import FeatureState

    rows = spark.range(0, 3000).select((F.col("id") % 5).cast("int").alias("k"), F.expr("date_add(DATE'2020-01-01', CAST(id % 1500 AS INT))").alias("d"), F.lit(1.0).alias("x")).cache()
    state = FeatureState(spark, f"{tmp_path}/state", A.History(rows, "k", "d", ["x"], (7, 365), True))
    state.extend(rows.where("d < DATE'2023-11-20'"))
    before = [t.manifest()["slots"] for t in (state.daily, state.carried)]
    state.extend(rows.where("d = DATE'2023-11-20'"))
    after = [t.manifest()["slots"] for t in (state.daily, state.carried)]
    assert [sum(b.get(s) != p for s, p in a.items()) for a, b in zip(after, before)] == [1, 1] and len(after[0]) > 40
    slate = spark.createDataFrame([(1, date(2023, 11, 21)), (3, date(2023, 11, 21))], "k int, d date")
    got = state.read(slate, "k", "d")
    slots = {f.split("_slot=")[1].split("/")[0] for f in got.inputFiles()}
    assert len(slots) == 2  # of the month of the day and its week before, and of the month a year before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, A.asof(rows.where("d < DATE'2023-11-21'"), slate, "k", "d", ["x"], (7, 365)).collect()))


def test_stored_totals_are_not_broadcast(spark, tmp_path):
    """Slices are small as files and large in memory: no join sends them through the driver."""
    from tidemark.operators.feature_state import FeatureState

    rows = spark.range(0, 400).select((F.col("id") % 50).cast("int").alias("k"), F.expr("date_add(DATE'2020-01-01', CAST(id % 90 AS INT))").alias("d"), F.lit(1.0).alias("x"))
    state = FeatureState(spark, f"{tmp_path}/state", A.History(rows, "k", "d", ["x"], (7, 365), True))
    state.extend(rows)
    got = state.read(rows.select("k", "d"), "k", "d")
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_survey_spares_totals_that_are_zero_throughout(spark):
    """Whole, gapless numbers need one total; fractions, huge values, gaps and infinities keep theirs, and no figure changes."""
    from datetime import date, timedelta

    inf, day = float("inf"), lambda i: date(2024, 1, 1) + timedelta(days=i % 40)
    rows = [(i % 5, day(i), float(i % 7), None if i % 3 else i / 3, 1e18 if i == 4 else 0.1 * i, inf if i == 9 else 1.0, i, None if i % 4 else i) for i in range(400)]
    values = ["plain", "gaps", "huge", "odd", "n", "n_gaps"]
    h = A.History(spark.createDataFrame(rows, "k int, d date, plain double, gaps double, huge double, odd double, n int, n_gaps int"), "k", "d", values, (3, 20), True, "h_")
    slim = h.surveyed()
    assert len(slim.needs["plain"].parts) == 1
    assert [slim.needs[v].missing for v in values] == [False, True, False, False, False, True]
    assert [slim.needs[v].odd for v in values] == [False, False, False, True, False, False]
    assert len(slim.needs["huge"].parts) > 1 and len(slim.totals()) < len(h.totals())
    asks = spark.createDataFrame([(i, i % 6, day(i + 3)) for i in range(60)], "rid int, k int, d date")
    got = lambda x: sorted(map(str, A.asof_many(asks, "k", "d", [x]).collect()))
    assert got(slim) == got(h)
    empty = A.History(h.rows.where("k > 9"), "k", "d", values, (3,), True, "h_")
    assert got(empty.surveyed()) == got(empty)


def test_histories_of_keys_that_nobody_asks_for_are_left_out(spark):
    """Few keys are broadcast and prune the history, many or keys of another type do not."""
    from datetime import date

    rows = spark.createDataFrame([(i % 50, date(2024, 1, 1 + i % 20), 1.0) for i in range(500)], "k int, d date, x double")
    asks = spark.createDataFrame([(1, 3, date(2024, 1, 30)), (2, None, date(2024, 1, 30)), (3, 7, date(2024, 1, 30))], "rid int, k int, d date")
    assert A.few_keys(asks, "k", 1) is None
    keys = A.few_keys(asks, "k")
    h = A.History(rows, "k", "d", ["x"], (7,), True, "h_")
    assert h.asked(keys).rows.count() == 20 and h.asked(keys.selectExpr("CAST(_wanted AS string) AS _wanted")).rows.count() == 500
    assert sorted(map(str, A.asof_many(asks, "k", "d", [h.asked(keys)]).collect())) == sorted(map(str, A.asof_many(asks, "k", "d", [h]).collect()))


def test_surveys_run_beside_each_other(spark, monkeypatch):
    """passes that only tell what histories need wait for each other's latency no longer; their order and results stay."""
    from threading import Barrier

    from tidemark.operators import features

    rows = spark.createDataFrame([(1, date(2024, 1, i), float(i), None) for i in range(1, 9)], "k int, d date, x double, y double")
    asks = spark.createDataFrame([(1, date(2024, 1, 5))], "k int, d date")
    histories = [A.History(rows, "k", "d", [v], (), True, f"{v}_") for v in ("x", "y")] + [A.LastRows(rows, "k", "d", "x", ["x"], 2)]
    alone = [x.surveyed().needs for x in histories[:2]]
    meet, survey = Barrier(2, timeout=60), A.History.surveyed
    monkeypatch.setattr(A.History, "surveyed", lambda self: (meet.wait(), survey(self))[1])
    got = features._slim(asks, "k", histories)
    assert [x.needs for x in got[:2]] == alone and isinstance(got[2], A.LastRows)
