"""Registered queries: every operator on the stand-in views, with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import exprs as X
from tidemark.operators import asof as A
from tidemark.operators import folds, latest, market, metrics, quality, vennabers
from tidemark.operators.feature_state import FeatureState
from tidemark.plans import catalogue, grading, registry
from tidemark.plans.views import NOW, Tables, with_views
from tidemark.sources import io, nested
from tidemark.sources.scratch import new_path, stage
from tidemark.sources.tables import KeyedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: On the stand-ins a quote is fresh for 20 days.
WIDE = replace(DEFAULT, max_quote_age_seconds=20 * 86_400)
now = lambda: F.lit(NOW).cast("timestamp_ntz")


def query(name: str, oracle: str | None = None):
    """Register a function of ``Tables`` under ``name``."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def one(name: str, view: str, columns: dict[str, tuple[Callable[[], Column], str]], where: tuple[str, str] | None = None, keep: str = "") -> None:
    """Register a projection given per column as (Spark, SQL)."""

    def run(t: Tables) -> DataFrame:
        df = getattr(t, view)
        if where:
            df = df.where(where[0])
        return df.select(*keep.split(), *[c().alias(n) for n, (c, _) in columns.items()])

    parts = [*keep.split(), *[f"{s} AS {n}" for n, (_, s) in columns.items()]]
    query(name, f"SELECT {', '.join(parts)} FROM {view}" + (f" WHERE {where[1]}" if where else ""))(run)


C = F.col

# ---- scans, sources, sinks ----------------------------------------------------------------------


def _scratch(t: Tables, name: str) -> str:
    return new_path(t.spark, name)


HIST = "k bigint, gid bigint, d date, x double, x_null double, status string, priority string"
HIST_SQL = "SELECT k, gid, d, x, x_null, status, priority FROM hist"


@query("a01_read_csv", HIST_SQL)
def _(t):
    t.hist.write.option("header", True).csv(path := _scratch(t, "a01"))
    return io.read_csv(t.spark, path, HIST)


@query("a02_read_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(t):
    return io.read_dataset(t.spark, f"{t.folder}/orders.parquet").drop("o_orderdate")


@query("a03_bulk_load", HIST_SQL)
def _(t):
    t.hist.write.json(path := _scratch(t, "a03"))
    return io.bulk_read(t.spark, path, "json", HIST)


@query("a04_export_replace", "SELECT pitcher, game, inning, event, launch FROM pitch")
def _(t):
    path = _scratch(t, "a04")
    io.export(t.pitch.limit(1).select("pitcher", "game", "inning", "event", "launch"), path)
    io.export(t.pitch.select("pitcher", "game", "inning", "event", "launch"), path)
    return t.spark.read.parquet(path)


@query("a05_sql_parameters", "SELECT k AS key, count(*) AS n FROM hist WHERE status = 'F' AND x > 100000 GROUP BY k")
def _(t):
    t.hist.createOrReplaceTempView("tidemark_hist")
    return io.sql(t.spark, "SELECT k AS KEY, count(*) AS N FROM tidemark_hist WHERE status = :s AND x > :x GROUP BY k", {"s": "F", "x": 100000})


@query("a06_append", "SELECT event_id, matchup, book FROM snap WHERE matchup % 2 = 0 UNION ALL SELECT event_id, matchup, book FROM snap WHERE matchup % 2 = 1")
def _(t):
    path = _scratch(t, "a06")
    rows = t.snap.select("event_id", "matchup", "book")
    io.append(rows.where("matchup % 2 = 0"), path)
    io.append(rows.where("matchup % 2 = 1"), path)
    io.append(rows.where("matchup < 0"), path)
    return t.spark.read.parquet(path)


#: Hash buckets of the queries' keyed tables.
BUCKETS = 8

UPSERTED = """SELECT gid, k, CASE WHEN gid % 7 = 0 THEN x + 1 ELSE x END AS x, status FROM hist WHERE gid % 5 <> 0
    UNION ALL SELECT gid, k, x + 1 AS x, CAST(NULL AS VARCHAR) AS status FROM hist WHERE gid % 5 = 0 AND gid % 7 = 0"""


def _upsert_parts(t):
    target = t.hist.where("gid % 5 <> 0").select("gid", "k", "x", "status")
    source = t.hist.where("gid % 7 = 0").select("gid", "k", (C("x") + 1).alias("x"))
    return target, source


@query("a07_upsert", UPSERTED)
def _(t):
    target, source = _upsert_parts(t)
    table = KeyedTable(t.spark, _scratch(t, "a07"), ["gid"], buckets=BUCKETS)
    table.upsert(target)
    table.upsert(source)
    table.upsert(source)  # again: nothing changes
    return table.read()


@query("a08_key_check", "SELECT count(*) AS null_key_rows FROM hist WHERE gid % 97 = 0")
def _(t):
    return quality.null_keys(t.hist.withColumn("gid", F.when(C("gid") % 97 != 0, C("gid"))), ["gid", "k"])


@query("a09_table_columns_added", "SELECT gid, k, CAST(NULL AS VARCHAR) AS note FROM hist")
def _(t):
    return t.hist.select("gid", "k").unionByName(t.spark.createDataFrame([], "gid bigint, k bigint, note string"), allowMissingColumns=True)


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("a10_catalog_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS place, count({c}) AS observed FROM orders" for i, c in enumerate(ORDER_COLUMNS)))
def _(t):
    return quality.catalog(t.orders)


def feeds(t: Tables) -> DataFrame:
    """One nested feed per order, as text."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    inning = F.struct(C("l_linenumber").alias("num"), F.format_string("%02d", C("l_quantity").cast("int")).alias("away_runs"), F.lit("0").alias("home_runs"))
    player = F.struct(C("l_suppkey").cast("string").alias("key"), F.struct(C("l_suppkey").alias("id"), (C("l_returnflag") == "A").cast("int").alias("started")).alias("value"))
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(inning)).alias("innings"), F.collect_list(player).alias("players"))
    per = per.withColumn("players", F.map_from_entries(F.transform(F.array_distinct(F.transform("players", lambda p: p["key"])), lambda k: F.filter("players", lambda p: p["key"] == k)[0])))
    status = F.when(C("o_orderstatus") == "F", "Final").otherwise("Live").alias("status")
    feed = F.struct(C("o_orderkey").cast("string").alias("game_id"), status, F.lit("a").alias("away_name"), F.lit("h").alias("home_name"), "innings", "players")
    return t.orders.join(per, C("o_orderkey") == C("l_orderkey")).select(F.to_json(feed).alias("feed"))


A11_SQL = """WITH l AS (SELECT o.o_orderkey AS g, min(l_quantity) FILTER (WHERE l_linenumber = 1) AS q
    FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT CAST(g AS VARCHAR) AS game_id, CAST(q AS BIGINT) AS runs_away, CAST(0 AS BIGINT) AS runs_home, CAST(q > 0 AS INTEGER) AS any_run FROM l WHERE q IS NOT NULL"""


@query("a11_nested_feed", A11_SQL)
def _(t):
    return nested.outcomes_of(feeds(t), "feed").drop("starter")


def odds_payloads(t: Tables) -> DataFrame:
    """One nested payload per event, as text."""
    outcome = lambda side, price: F.struct(F.lit(side).alias("side"), price.cast("string").alias("price"))
    markets = F.array(F.struct(
        F.when(C("event_id") % 3 == 0, "other").otherwise("first").alias("id"), F.lit("0.5").alias("line"),
        F.when(C("event_id") % 2 == 0, F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated_at"),
        F.array(outcome("Over", C("price")), outcome("Under", C("under"))).alias("outcomes"),
    ))
    book = F.struct(F.concat(F.lit(" "), F.upper("book")).alias("name"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), markets.alias("markets"))
    return t.snap.select(F.to_json(F.struct(C("event_id").cast("string").alias("fixture_id"), F.array(book).alias("books"))).alias("payload"))


A12_SQL = """WITH q AS (SELECT event_id, book, price, CASE WHEN price > 0 THEN 100 / (price + 100) ELSE abs(price) / (abs(price) + 100) END AS a,
    CAST(110 AS DOUBLE) / 210 AS b, strftime(captured_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM snap WHERE event_id % 3 <> 0)
  SELECT CAST(event_id AS VARCHAR) AS fixture_id, book, price AS over_price, round(a / (a + b), 6) AS p_novig,
    sha1(CAST(event_id AS VARCHAR) || '|' || book || '|' || iso) AS snapshot_id FROM q"""


@query("a12_nested_quotes", A12_SQL)
def _(t):
    q = nested.quotes_of(odds_payloads(t), "payload", "first")
    return q.select("fixture_id", "book", C("over").alias("over_price"), r("p_novig").alias("p_novig"), "snapshot_id")


@query("a13_feature_store_rows", """SELECT gid, 'v1' AS feature_version, CAST(CASE WHEN x_null IS NULL THEN 1 ELSE 0 END AS INTEGER) AS missing_count,
    CASE WHEN x_null IS NULL THEN 0.5 ELSE CAST(1 AS DOUBLE) END AS coverage, CAST(length('x') AS INTEGER) AS has_null_key FROM hist""")
def _(t):
    rows = io.feature_rows(t.hist, ["gid"], ["x", "x_null"], "v1", NOW)
    return rows.select("gid", "feature_version", "missing_count", "coverage", F.size(F.expr("filter(json_object_keys(f), k -> k = 'x_null')")).alias("has_null_key"))


@query("a14_backfill_range", "SELECT gid, x + CASE WHEN gid % 2 = 0 AND d BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' THEN 1 ELSE 0 END AS x FROM hist WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def _(t):
    half = t.hist.where("d BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'").select("gid", "x", F.date_format("d", "yyyy-MM").alias("month"), "d")
    path = _scratch(t, "a14")
    table = KeyedTable(t.spark, path, ["gid", "month"], ["month"])
    table.upsert(half)
    # the source has every second row of the range; the others stay
    io.backfill(half.where("gid % 2 = 0").withColumn("x", C("x") + 1), table, "month", "1996-01", "1996-03")
    return table.read().select("gid", "x")


# ---- validation ---------------------------------------------------------------------------------

MESSY = {"d_text": ("CASE WHEN gid % 97 = 0 THEN 'no date' ELSE CAST(d AS {s}) END"), "x_text": "CASE WHEN gid % 89 = 0 THEN 'n/a' ELSE CAST(gid AS {s}) END"}
messy = lambda t: t.hist.select("gid", "k", "status", *[F.expr(e.format(s="STRING")).alias(n) for n, e in MESSY.items()])


@query("b01_normalised_columns", "SELECT gid, k AS key FROM hist")
def _(t):
    return quality.normalise_columns(t.hist.select(C("gid").alias(" GID "), C("k").alias("Key")))


B02_SQL = """SELECT 'renamed' AS load, 'hist: missing columns [''priority'']' AS refusal, CAST(NULL AS BIGINT) AS n
   UNION ALL SELECT 'extra', 'hist: unknown columns [''note'']', NULL UNION ALL SELECT 'whole', NULL, count(*) FROM hist"""


@query("b02_column_contract", B02_SQL)
def _(t):
    from tidemark.specs import DatasetSpec

    spec = DatasetSpec("hist", {"gid": "bigint", "k": "bigint", "d": "date", "x": "double", "x_null": "double", "status": "string", "priority": "string"}, ("gid",))
    loads = {"renamed": t.hist.withColumnRenamed("priority", "note"), "extra": t.hist.withColumn("note", F.lit("")), "whole": t.hist}
    out = []
    for name, rows in loads.items():
        refusal, n = None, F.count(F.lit(1))
        try:
            quality.check_columns(rows.columns, spec)
        except io.ContractError as e:
            refusal, n = str(e), F.lit(None).cast("bigint")
        out.append(rows.agg(n.alias("n")).select(F.lit(name).alias("load"), F.lit(refusal).cast("string").alias("refusal"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("b03_sorted_projection", "SELECT d, gid, k, x FROM hist")
def _(t):
    return t.hist.select(*sorted({"x", "k", "gid", "d"}))


@query("b04_strict_dates", "SELECT gid, CASE WHEN gid % 97 = 0 THEN NULL ELSE d END AS d, gid % 97 = 0 AS bad FROM hist")
def _(t):
    day, bad = quality.strict_date(C("d_text"))
    return messy(t).select("gid", day.alias("d"), bad.alias("bad"))


@query("b05_strict_numbers", "SELECT gid, CASE WHEN gid % 89 = 0 THEN NULL ELSE CAST(gid AS DOUBLE) END AS x, gid % 89 = 0 AS bad FROM hist")
def _(t):
    number, bad = quality.strict_double(C("x_text"))
    return messy(t).select("gid", number.alias("x"), bad.alias("bad"))


@query("b06_null_keys", "SELECT count(*) FILTER (WHERE x_null IS NULL) AS null_key_rows FROM hist")
def _(t):
    return quality.null_keys(t.hist, ["gid", "x_null"])


@query("b07_duplicate_keys", "SELECT game, inning, count(*) AS n FROM pitch GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5")
def _(t):
    return quality.key_problems(t.pitch, ["game", "inning"])


@query("b08_validated_load", "SELECT d, gid, k, x, 'feed' AS source, CAST(2024 AS INTEGER) AS loaded_in FROM hist")
def _(t):
    from tidemark.specs import DatasetSpec

    spec = DatasetSpec("hist", {"gid": "bigint", "k": "bigint", "d": "date", "x": "double"}, ("gid",), date_column="d")
    rows = t.hist.select(C("gid").cast("string").alias("GID "), "k", C("d").cast("string").alias("d"), C("x").cast("string").alias("x"))
    out = quality.validate(rows, spec, "feed", F.lit(NOW).cast("timestamp"))
    return out.withColumn("loaded_in", F.year("ingested_at")).drop("ingested_at")


@query("b09_empty_input", "SELECT count(*) = 0 AS empty, count(*) AS n FROM hist WHERE x < 0")
def _(t):
    return t.hist.where("x < 0").agg((F.count(F.lit(1)) == 0).alias("empty"), F.count(F.lit(1)).alias("n"))


PROFILES = "SELECT 'orders' AS table_name, count(*) AS row_count, min(CAST(o_orderdate AS DATE)) AS min_date, max(CAST(o_orderdate AS DATE)) AS max_date FROM orders UNION ALL SELECT 'lineitem', count(*), min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'events', count(*), min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) FROM events UNION ALL SELECT 'part', count(*), NULL, NULL FROM part"


def profiles(t):
    one = [quality.profile(getattr(t, n), n, d) for n, d in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"), ("part", None))]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


@query("b10_table_profiles", PROFILES)
def _(t):
    return profiles(t)


CONTRACTS = [
    ("orders", 1000, "1995-01-01", "2001-01-01", None), ("lineitem", 10_000_000, "1990-01-01", None, None), ("events", 10, None, "2030-01-01", "2024-01-15"),
    ("part", 5, "2000-01-01", None, None), ("absent", 1, None, None, None),
]


def errors(t):
    rows = [(n, [], m, *(date.fromisoformat(x) if x else None for x in d)) for n, m, *d in CONTRACTS]
    contracts = t.spark.createDataFrame(rows, "table_name string, required array<string>, minimum_rows bigint, start date, end date, before date")
    return quality.contract_errors(profiles(t), contracts)


def _sql_date(x: str | None) -> str:
    return f"DATE '{x}'" if x else "CAST(NULL AS DATE)"


_C = " UNION ALL ".join(f"SELECT '{n}' AS table_name, {m} AS minimum_rows, {_sql_date(a)} AS s, {_sql_date(b)} AS e, {_sql_date(c)} AS before" for n, m, a, b, c in CONTRACTS)
ERRORS = f"""WITH p AS ({PROFILES}), c AS ({_C}), j AS (SELECT c.table_name, row_count, min_date, max_date, minimum_rows, s, e, before FROM c LEFT JOIN p ON c.table_name = p.table_name),
  x AS (SELECT table_name, unnest([CASE WHEN row_count IS NULL THEN 'table_missing' END,
    CASE WHEN row_count < minimum_rows THEN 'row_count_' || row_count || '_below_' || minimum_rows END,
    CASE WHEN row_count IS NOT NULL AND s IS NOT NULL AND (min_date IS NULL OR max_date IS NULL) THEN 'date_coverage_unknown' END,
    CASE WHEN min_date > s THEN 'starts_' || min_date || '_after_' || s END,
    CASE WHEN max_date < e THEN 'ends_' || max_date || '_before_' || e END,
    CASE WHEN max_date >= before THEN 'reaches_into_holdout' END]) AS error FROM j)"""


def _flat(kind: str):
    def run(t):
        return errors(t).select("table_name", F.explode("errors").alias("error")).where(C("error").rlike(kind))

    return run


query("b11_contract_errors", ERRORS + " SELECT table_name, error FROM x WHERE error LIKE 'row_count%' OR error = 'table_missing'")(_flat("^row_count|^table_missing"))
query("b12_date_coverage", ERRORS + " SELECT table_name, error FROM x WHERE error LIKE 'starts%' OR error LIKE 'ends%' OR error LIKE 'date%'")(_flat("^(starts|ends|date)_"))
query("b13_no_future", ERRORS + " SELECT table_name, error FROM x WHERE error LIKE 'reaches%'")(_flat("^reaches"))


@query("b14_readiness", ERRORS + " SELECT count(error) = 0 AS ready, array_to_string(list_sort(list(table_name || ':' || error) FILTER (WHERE error IS NOT NULL)), ';') AS errors FROM x")
def _(t):
    return quality.readiness(errors(t)).select("ready", F.array_join("errors", ";").alias("errors"))


@query("b15_gate", ERRORS + " SELECT table_name, count(error) = 0 AS passed, count(error) AS n_errors FROM x GROUP BY 1")
def _(t):
    found, out = errors(t).persist(), []
    for name, *_ in CONTRACTS:  # a gate per table
        mine = found.where(C("table_name") == name)
        try:
            quality.require_ready(mine)
            passed = True
        except io.ContractError:
            passed = False
        out.append(mine.select("table_name", F.lit(passed).alias("passed"), F.size("errors").cast("long").alias("n_errors")))
    return reduce(DataFrame.unionByName, out)


@query("b16_target_report", "SELECT count(*) AS n, count(DISTINCT y) AS classes, count(*) FILTER (WHERE y IS NULL) AS bad_labels, min(game) AS first_day, max(game) AS last_day FROM cust_y")
def _(t):
    return quality.target_report(t.cust_y, "y", "game")


one("b17_whole_number_runs", "hist", {"runs": (lambda: X.as_int(F.when(C("gid") % 4 == 0, "1.5").otherwise((C("gid") % 9 - 1).cast("string"))), "CASE WHEN gid % 4 = 0 THEN NULL ELSE gid % 9 - 1 END")}, ("gid % 4 <> 0 AND gid % 9 >= 1", "gid % 4 <> 0 AND gid % 9 >= 1"), "gid")
one("b18_valid_probability", "pred", {"valid": (lambda: X.probability(F.when(C("event_id") % 13 == 0, F.lit("NaN").cast("double")).when(C("event_id") % 17 == 0, 1.5).otherwise(C("p"))), "event_id % 13 <> 0 AND event_id % 17 <> 0")}, None, "event_id")

# ---- projections and predicates -----------------------------------------------------------------


@query("c01_pruned_scan", "SELECT k, d, x FROM hist WHERE d < DATE '1998-01-01'")
def _(t):
    return t.hist.select("k", "d", "x").where("d < DATE '1998-01-01'")


@query("c02_slice", "SELECT pitcher, game, launch FROM pitch WHERE inning = 1")
def _(t):
    return t.pitch.where("inning = 1").select("pitcher", "game", "launch")


@query("c03_range_not_null", "SELECT gid, x_null FROM hist WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND x_null IS NOT NULL")
def _(t):
    return t.hist.where(C("d").between("1996-01-01", "1997-12-31") & C("x_null").isNotNull()).select("gid", "x_null")


@query("c04_status_membership", "SELECT gid, status FROM hist WHERE status IN ('F', 'O')")
def _(t):
    return t.hist.where(C("status").isin("F", "O")).select("gid", "status")


@query("c05_first_matching", "SELECT l_orderkey AS game, min(l_quantity) AS quantity FROM lineitem WHERE l_linenumber = 2 GROUP BY 1")
def _(t):
    arrays = t.basket_rows.groupBy("game").agg(F.sort_array(F.collect_list(F.struct("ln", "qty"))).alias("a"))
    hit = X.first_matching(C("a"), lambda e: e["ln"] == 2)
    return arrays.select("game", hit["qty"].alias("quantity")).where("quantity IS NOT NULL")


@query("c06_market_and_line", "SELECT event_id FROM snap WHERE event_id % 3 <> 0 AND abs(p - 0.5) <= 1e-9")
def _(t):
    rows = t.snap.select("event_id", F.when(C("event_id") % 3 == 0, "other").otherwise("first").alias("market"), C("p").cast("string").alias("line"))
    return rows.where((C("market") == "first") & (F.abs(C("line").try_cast("double") - 0.5) <= 1e-9)).select("event_id")


AGE = f"CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(captured_at)) AS BIGINT)"


@query("c07_fresh_quotes", f"SELECT event_id, {AGE} AS age_s FROM snap WHERE {AGE} BETWEEN 0 AND 1728000")
def _(t):
    rows = t.snap.withColumn("age_s", market.age_seconds(C("captured_at"), now()))
    return rows.where(C("age_s").between(0, WIDE.max_quote_age_seconds)).select("event_id", "age_s")


@query("c08_valid_quotes", "SELECT event_id FROM snap WHERE p BETWEEN 0 AND 1 AND price <> 0 AND event_id % 10 <> 0")
def _(t):
    price = F.when(C("event_id") % 20 == 0, 0.0).when(C("event_id") % 20 == 10, float("inf")).otherwise(C("price"))
    return t.snap.where(market.quote_valid(C("p"), price)).select("event_id")


REG = """(SELECT k AS model_version, CASE WHEN min(gid) % 3 = 0 THEN 'production' ELSE 'candidate' END AS status, max(x) AS trained, count(*) % 2 = 0 AS gates_passed, min(gid) % 5 <> 0 AS holdout_passed, CASE WHEN min(gid) % 4 = 0 THEN NULL ELSE min(gid) % 4 = 1 END AS burned FROM hist GROUP BY k)"""


def reg(t):
    low = F.min("gid")
    return t.hist.groupBy(C("k").alias("model_version")).agg(
        F.when(low % 3 == 0, "production").otherwise("candidate").alias("status"), F.max("x").alias("trained_at"), (F.count(F.lit(1)) % 2 == 0).alias("gates_passed"),
        (low % 5 != 0).alias("holdout_passed"), F.when(low % 4 != 0, low % 4 == 1).alias("holdout_burned_rerun"), F.lit("{}").alias("gate_report"),
    )


APPROVED = f"{REG} r WHERE status = 'production' AND gates_passed AND holdout_passed AND NOT coalesce(burned, false)"


@query("c09_registry_predicate", f"SELECT model_version, trained FROM {APPROVED}")
def _(t):
    return registry.approved(reg(t)).select("model_version", C("trained_at").alias("trained"))


@query("c10_trailing_period", f"SELECT event_id FROM grades WHERE graded_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def _(t):
    return t.grades.where(latest.since("graded_at", now(), 10)).select("event_id")


one("c11_null_safe_label", "hist", {"y": (lambda: F.when(C("x_null") > 200000, 1).otherwise(0), "CAST(CASE WHEN x_null > 200000 THEN 1 ELSE 0 END AS INTEGER)")}, None, "gid")
one("c12_event_classes", "pitch", {"hit": (lambda: C("event").isin("A", "R").cast("int"), "CAST(event IN ('A', 'R') AS INTEGER)"), "walk": (lambda: (C("event") == "N").cast("int"), "CAST(event = 'N' AS INTEGER)")}, None, "game inning")
one("c13_pattern_flag", "part_dim", {"hit": (lambda: (C("name").like("%red%") | C("brand").isin("Brand#1", "Brand#2")).cast("int"), "CAST(name LIKE '%red%' OR brand IN ('Brand#1', 'Brand#2') AS INTEGER)")}, None, "venue")
one("c14_null_preserving_indicator", "hist", {"big": (lambda: X.indicator(C("x_null"), C("x_null") > 200000), "CASE WHEN x_null IS NULL THEN NULL WHEN x_null > 200000 THEN CAST(1 AS DOUBLE) ELSE 0 END")}, None, "gid")
one("c15_row_delta", "pitch", {"delta": (lambda: r(C("post") - C("pre"), 4), "round(post - pre, 4)")}, None, "game inning")


def feat(t: Tables) -> DataFrame:
    """Training matrix: as-of features of every order's customer on its day."""
    req = t.hist.select(C("gid").alias("rid"), "k", "d", (C("x") > 200000).cast("int").alias("label"))
    f = A.asof(t.hist, req, "k", "d", ["x", "x_null"], (90, 365))
    return f.select(
        "rid", "k", "d", "label", A.per_observation(C("90d_x"), C("90d_x_n")).alias("f1"), A.per_observation(C("365d_x_null"), C("365d_x_null_n")).alias("f2"),
        A.per_observation(C("all_x"), C("all_x_n")).alias("f3"), F.datediff("d", "prev_day").cast("double").alias("f4"),
    )


FEATS = ["f1", "f2", "f3", "f4"]
FEAT = """(SELECT r.gid AS rid, r.k, r.d, CAST(r.x > 200000 AS INTEGER) AS label,
   sum(CASE WHEN h.d >= r.d - 90 THEN h.x END) / count(CASE WHEN h.d >= r.d - 90 THEN h.x END) AS f1,
   (CASE WHEN count(CASE WHEN h.d >= r.d - 365 THEN h.x_null END) > 0 THEN sum(CASE WHEN h.d >= r.d - 365 THEN h.x_null END) / count(CASE WHEN h.d >= r.d - 365 THEN h.x_null END) END) AS f2,
   sum(h.x) / count(h.x) AS f3, CAST(r.d - max(h.d) AS DOUBLE) AS f4
   FROM hist r LEFT JOIN hist h ON h.k = r.k AND h.d < r.d GROUP BY r.gid, r.k, r.d, r.x)"""
COVER = "(CAST(f1 IS NOT NULL AS INTEGER) + CAST(f2 IS NOT NULL AS INTEGER) + CAST(f3 IS NOT NULL AS INTEGER) + CAST(f4 IS NOT NULL AS INTEGER)) / CAST(4 AS DOUBLE)"


@query("c16_coverage_gate", f"SELECT count(*) AS n, count(*) FILTER (WHERE {COVER} < 0.85) AS dropped FROM {FEAT} f")
def _(t):
    return feat(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(A.coverage(FEATS) < 0.85).alias("dropped"))


@query("c17_rename", "SELECT gid AS game_id, k AS away_id, d AS game_date FROM hist")
def _(t):
    return t.hist.select(C("gid").alias("game_id"), C("k").alias("away_id"), C("d").alias("game_date"))


# ---- as-of joins, aggregates and frames ---------------------------------------------------------

WINDOW = """FROM requests r LEFT JOIN hist h ON h.k = r.k AND h.d < r.d {0} GROUP BY r.rid"""


@query("d01_asof_features", """SELECT r.rid, count(h.k) FILTER (WHERE h.d >= r.d - 365) AS rows_365, round(sum(h.x) FILTER (WHERE h.d >= r.d - 365), 2) AS x_365,
   count(h.x_null) AS seen, round(sum(h.x) / count(h.x), 6) AS mean_all, max(h.d) AS prev_day """ + WINDOW.format(""))
def _(t):
    f = A.asof(t.hist, t.requests, "k", "d", ["x", "x_null"], (365,))
    return f.select("rid", F.coalesce("365d_rows", F.lit(0)).cast("long").alias("rows_365"), r("365d_x", 2).alias("x_365"), F.coalesce("all_x_null_n", F.lit(0)).alias("seen"), r(A.per_observation(C("all_x"), C("all_x_n"))).alias("mean_all"), "prev_day")


@query("d02_two_roles", """WITH g AS (SELECT gid AS rid, k AS away, (k + 7) % 1500 AS home, d FROM hist),
  s AS (SELECT rid, away AS k, d, 'away' AS role FROM g UNION ALL SELECT rid, home, d, 'home' FROM g)
  SELECT s.rid, round(sum(h.x) FILTER (WHERE role = 'away'), 2) AS away_sum, round(sum(h.x) FILTER (WHERE role = 'home'), 2) AS home_sum FROM s LEFT JOIN hist h ON h.k = s.k AND h.d < s.d GROUP BY s.rid""")
def _(t):
    games = t.hist.select(C("gid").alias("rid"), C("k").alias("away"), ((C("k") + 7) % 1500).alias("home"), "d")
    sides = A.two_sided(games, "rid", {"away": "away", "home": "home"}, ["d"])
    f = A.asof(t.hist, sides, "k", "d", ["x"], (), True, "entity", "d").withColumn("sum", r("all_x", 2))
    return A.by_role(f, "rid", ["away", "home"], ["sum"])


@query("d03_dimension_lookup", "SELECT b.game, b.ln, b.id, p.factor FROM basket_rows b LEFT JOIN part_dim p ON b.id + 500 = p.venue")
def _(t):
    return t.basket_rows.join(t.part_dim.select(C("venue").alias("_v"), "factor"), C("id") + 500 == C("_v"), "left").select("game", "ln", "id", "factor")


RATES = "(SELECT k AS venue, avg(CASE WHEN x > 200000 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate, count(*) AS n FROM hist GROUP BY k HAVING count(*) >= 10)"


@query("d04_base_rate_lookup", f"SELECT h.gid, round(v.rate, 6) AS rate FROM hist h LEFT JOIN {RATES} v ON h.k = v.venue")
def _(t):
    rates = metrics.group_rates(t.hist.withColumn("y", (C("x") > 200000).cast("int")), "k", "y", 10)
    return t.hist.join(rates.select("k", "rate"), "k", "left").select("gid", r("rate").alias("rate"))


@query("d05_known_outcomes", "SELECT p.event_id, p.p, c.y FROM pred p JOIN cust_y c ON p.game = c.game WHERE c.y IS NOT NULL")
def _(t):
    return t.pred.join(t.cust_y.where("y IS NOT NULL"), "game").select("event_id", "p", "y")


LAST_SNAP = "(SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY matchup, book ORDER BY captured_at DESC, event_id DESC) = 1)"


def last_snap(t):
    return latest.latest(t.snap, ["matchup", "book"], "captured_at", ["event_id"])


@query("d06_closing_market", f"SELECT c.game, c.y, round(m.p_close, 6) AS p_close FROM cust_y c LEFT JOIN (SELECT matchup, median(p) AS p_close FROM {LAST_SNAP} s GROUP BY 1) m ON m.matchup = c.game WHERE c.y IS NOT NULL")
def _(t):
    close = market.closing_price(last_snap(t), ["matchup"], "p").withColumnRenamed("matchup", "game")
    return t.cust_y.where("y IS NOT NULL").join(close, "game", "left").select("game", "y", r("p_close").alias("p_close"))


@query("d07_grades_predictions", "SELECT g.game, g.tier, count(*) AS n FROM grades g JOIN pred p ON g.game = p.game AND g.tier = p.tier GROUP BY 1, 2")
def _(t):
    return t.grades.join(t.pred.select("game", "tier"), ["game", "tier"]).groupBy("game", "tier").agg(F.count(F.lit(1)).alias("n"))


CONSENSUS = f"""(SELECT matchup, CASE WHEN n >= 2 THEN m END AS p_market, CASE WHEN n >= 2 THEN b END AS best_price, n AS books_n, age AS age_s FROM
   (SELECT matchup, median(p) FILTER (WHERE ok) AS m, max(price) FILTER (WHERE ok) AS b, count(*) FILTER (WHERE ok) AS n, coalesce(max(age) FILTER (WHERE ok), min(age) FILTER (WHERE age >= 0)) AS age
    FROM (SELECT *, {AGE} AS age, {AGE} BETWEEN 0 AND 43200 AS ok FROM {LAST_SNAP} z) y GROUP BY matchup) w)"""
DAY = replace(DEFAULT, max_quote_age_seconds=43_200)


def consensus(t):
    return market.consensus(last_snap(t), ["matchup"], "p", "price", "captured_at", now(), DAY)


@query("d08_games_with_market", f"SELECT c.game, m.books_n, round(m.p_market, 6) AS p_market FROM cust_y c LEFT JOIN {CONSENSUS} m ON m.matchup = c.game")
def _(t):
    return t.cust_y.join(consensus(t).withColumnRenamed("matchup", "game"), "game", "left").select("game", "books_n", r("p_market").alias("p_market"))


@query("d09_fixture_columns", "SELECT s.event_id, s.book, c.venue FROM snap s JOIN cust_y c ON s.matchup = c.game")
def _(t):
    return t.snap.join(t.cust_y.select(C("game").alias("matchup"), "venue"), "matchup").select("event_id", "book", "venue")


PARTHIST = "(SELECT l_partkey AS id, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS num, l_quantity AS den FROM lineitem)"
TOP3 = "(SELECT game, id, row_number() OVER (PARTITION BY game ORDER BY ln, id, qty) AS place FROM basket_rows)"
D10_SQL = f"""WITH m AS (SELECT game, place, id FROM {TOP3} x WHERE place <= 3), g AS (SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS d FROM orders),
  v AS (SELECT m.game, m.place, sum(h.num) / CASE WHEN sum(h.den) = 0 THEN NULL ELSE sum(h.den) END AS value FROM m JOIN g ON g.game = m.game LEFT JOIN {PARTHIST} h ON h.id = m.id AND h.d < g.d AND h.d >= g.d - 365 GROUP BY 1, 2)
  SELECT game, CASE WHEN count(value) = 3 THEN round(avg(value), 4) END AS top_mean FROM v GROUP BY game"""


def baskets(t):
    rows = t.basket_rows.groupBy("game").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "id", "qty"))), lambda s: s["id"]).alias("ids"))
    return rows.join(t.orders.select(C("o_orderkey").alias("game"), C("o_orderdate").cast("date").alias("d")), "game")


def top3(t):
    h = t.lineitem.select(C("l_partkey").alias("id"), C("l_shipdate").cast("date").alias("hd"), C("l_extendedprice").alias("num"), C("l_quantity").alias("den"))
    return A.top_members_mean(h, baskets(t), "game", "ids", "d", "id", "hd", "num", "den", 365).select("game", r("top_mean", 4).alias("top_mean"))


query("d10_lineup_members", D10_SQL)(top3)


@query("d11_upsert_match", "WITH u AS (" + UPSERTED + ") SELECT count(*) AS n, round(sum(x), 2) AS total, count(status) AS with_status FROM u")
def _(t):
    target, source = _upsert_parts(t)
    return io.merged(target, source, ["gid"]).agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 2).alias("total"), F.count("status").alias("with_status"))


PLACED = "(SELECT gid AS rid, d, row_number() OVER (ORDER BY d, gid) - 1 AS position FROM hist)"
FOLDS = f"""(SELECT fold, lo, hi, cutoff, (SELECT count(*) FROM {PLACED} q WHERE q.position < e.lo AND q.d <= e.cutoff) AS n_train FROM
   (SELECT k AS fold, n * k // 6 AS lo, n * (k + 1) // 6 AS hi, (SELECT min(d) FROM {PLACED} p WHERE p.position >= n * k // 6 AND p.position < n * (k + 1) // 6) - 7 AS cutoff
    FROM (SELECT count(*) AS n FROM hist) c, (SELECT unnest([1, 2, 3, 4, 5]) AS k) f) e)"""


def placed(t):
    return folds.positions(t.hist.select(C("gid").alias("rid"), "d"), "d", "rid")


@query("d12_fold_membership", f"SELECT fold, 'train' AS part, n_train AS n FROM {FOLDS} f WHERE n_train >= 200 UNION ALL SELECT fold, 'validation', hi - lo FROM {FOLDS} f WHERE n_train >= 200")
def _(t):
    rows = placed(t)
    return folds.members(rows, folds.fold_table(rows, "d"), "d").groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


def intervals_sql(pairs: str, calibrates: str = "true") -> str:
    """Venn-ABERS by definition: the largest over left ends of the smallest over right ends of block means that
    hold the test point. ``pairs``: rows ``model, event_id, p, y``."""
    return f"""(WITH q AS ({pairs}), c AS (SELECT model, p AS s, count(*) AS n, sum(y) AS pos FROM q WHERE {calibrates} GROUP BY 1, 2),
   ends AS (SELECT model, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(pos) OVER w AS cy FROM c WINDOW w AS (PARTITION BY model ORDER BY s) UNION ALL SELECT DISTINCT model, 0, 0, 0 FROM c),
   pl AS (SELECT x.model, x.p, (SELECT count(*) FROM c WHERE c.model = x.model AND c.s < x.p) AS lo, (SELECT count(*) FROM c WHERE c.model = x.model AND c.s <= x.p) AS hi FROM (SELECT DISTINCT model, p FROM q) x),
   v AS (SELECT pl.model, pl.p, a.i, min((b.cy - a.cy) / CAST(b.cn - a.cn + 1 AS DOUBLE)) AS m0, min((b.cy - a.cy + 1) / CAST(b.cn - a.cn + 1 AS DOUBLE)) AS m1
     FROM pl JOIN ends a ON a.model = pl.model AND a.i <= pl.lo JOIN ends b ON b.model = pl.model AND b.i >= pl.hi GROUP BY 1, 2, 3),
   z AS (SELECT model, p, max(m0) AS p0, max(m1) AS p1 FROM v GROUP BY 1, 2)
   SELECT q.event_id, p0, p1 FROM q JOIN z ON z.model = q.model AND z.p = q.p)"""


INTERVALS = "round(p0, 6) AS p0, round(p1, 6) AS p1, round(p1 / (1 - p0 + p1), 6) AS p_cal"


@query("d13_interval_lookup", f"SELECT event_id, {INTERVALS} FROM " + intervals_sql("SELECT 'm' AS model, event_id, p, y FROM grades", "event_id % 2 = 0") + " x")
def _(t):
    pairs = t.grades.withColumn("model", F.lit("m"))
    table = vennabers.calibrate(pairs.where("event_id % 2 = 0"), "model", "p", "y")  # half calibrates, all are looked up
    return vennabers.apply(pairs, table, "model", "p").select("event_id", r("p0").alias("p0"), r("p1").alias("p1"), r("p_cal").alias("p_cal"))


@query("d14_games_without_market", f"SELECT c.game, CASE WHEN m.p_market IS NULL THEN 'no_market_consensus' END AS reason FROM cust_y c LEFT JOIN {CONSENSUS} m ON m.matchup = c.game")
def _(t):
    joined = market.with_market(t.cust_y, consensus(t).withColumnRenamed("matchup", "game"), ["game"], DAY)
    return joined.select("game", C("market_reason").alias("reason"))


@query("e01_windowed_sums", "SELECT r.rid, CASE WHEN count(h.k) > 0 THEN round(sum(coalesce(h.x_null, 0)), 2) END AS total, CASE WHEN count(h.x_null) > 0 THEN count(h.x_null) END AS seen " + WINDOW.format("AND h.d >= r.d - 90"))
def _(t):
    return A.asof(t.hist, t.requests, "k", "d", ["x_null"], (90,), False).select("rid", r("90d_x_null", 2).alias("total"), C("90d_x_null_n").alias("seen"))


@query("e02_ratio_of_sums", "SELECT r.rid, round(9 * sum(coalesce(h.x_null, 0)) / CASE WHEN sum(h.x) = 0 THEN NULL ELSE sum(h.x) END, 6) AS ratio " + WINDOW.format("AND h.d >= r.d - 365"))
def _(t):
    f = A.asof(t.hist, t.requests, "k", "d", ["x", "x_null"], (365,), False)
    return f.select("rid", r(A.ratio(C("365d_x_null"), C("365d_x"), 9.0)).alias("ratio"))


@query("e03_combined_ratio", "SELECT r.rid, round(sum(h.x + coalesce(h.x_null, 0)) / sum(h.x), 6) AS ratio " + WINDOW.format(""))
def _(t):
    f = A.asof(t.hist, t.requests, "k", "d", ["x", "x_null"])
    return f.select("rid", r(A.ratio(C("all_x") + C("all_x_null"), C("all_x"))).alias("ratio"))


@query("e04_mean_of_observed", "SELECT r.rid, round(avg(h.x_null), 6) AS mean " + WINDOW.format(""))
def _(t):
    f = A.asof(t.hist, t.requests, "k", "d", ["x_null"])
    return f.select("rid", r(A.per_observation(C("all_x_null"), C("all_x_null_n"))).alias("mean"))


@query("e05_rows_and_observed", "SELECT r.rid, CASE WHEN count(h.k) > 0 THEN count(h.k) END AS n_rows, CASE WHEN count(h.x_null) > 0 THEN count(h.x_null) END AS n_seen " + WINDOW.format(""))
def _(t):
    return A.asof(t.hist, t.requests, "k", "d", ["x_null"]).select("rid", C("all_rows").alias("n_rows"), C("all_x_null_n").alias("n_seen"))


@query("e06_first_slice_lines", """SELECT pitcher, game, d, round(sum(post - pre), 4) AS runs, CAST(sum(CASE WHEN event IN ('A', 'R') THEN 1 ELSE 0 END) AS BIGINT) AS hits,
   CAST(sum(CASE WHEN event = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS walks, count(*) AS pa FROM pitch WHERE inning = 1 GROUP BY 1, 2, 3""")
def _(t):
    return t.pitch.where("inning = 1").groupBy("pitcher", "game", "d").agg(
        r(F.sum(C("post") - C("pre")), 4).alias("runs"), F.sum(C("event").isin("A", "R").cast("int")).alias("hits"), F.sum((C("event") == "N").cast("int")).alias("walks"), F.count(F.lit(1)).alias("pa")
    )


@query("e07_daily_conditional_sums", "SELECT pitcher, d, sum(launch) AS total, count(*) FILTER (WHERE launch >= 25) AS hard, count(*) FILTER (WHERE description = 'O') AS swings FROM pitch GROUP BY 1, 2")
def _(t):
    return t.pitch.groupBy("pitcher", "d").agg(F.sum("launch").alias("total"), F.count_if(C("launch") >= 25).alias("hard"), F.count_if(C("description") == "O").alias("swings"))


@query("e08_exact_median", f"SELECT matchup, round(median(p), 6) AS p_close FROM {LAST_SNAP} s GROUP BY 1")
def _(t):
    return market.closing_price(last_snap(t), ["matchup"], "p").select("matchup", r("p_close").alias("p_close"))


@query("e09_consensus", f"SELECT matchup, round(p_market, 6) AS p_market, round(best_price, 4) AS best_price, books_n FROM {CONSENSUS} c")
def _(t):
    return consensus(t).select("matchup", r("p_market").alias("p_market"), r("best_price", 4).alias("best_price"), "books_n")


@query("e10_consensus_age", f"SELECT matchup, age_s FROM {CONSENSUS} c")
def _(t):
    return consensus(t).select("matchup", "age_s")


@query("e11_books_map", f"SELECT matchup, count(*) AS n_books, round(sum(p), 6) AS p_sum FROM {LAST_SNAP} s GROUP BY 1")
def _(t):
    m = market.books_map(last_snap(t), ["matchup"], "book", ["p", "price"], "captured_at")
    total = F.aggregate(F.map_values("books"), F.lit(0.0), lambda a, b: a + b["p"])
    return m.select("matchup", F.size("books").cast("long").alias("n_books"), r(total).alias("p_sum"))


BRIER = "pow(p - y, 2)"
PC = "least(greatest(p, 1e-6), 1 - 1e-6)"
LOSS = f"(-(y * ln({PC}) + (1 - y) * ln(1 - {PC})))"


@query("e12_summary", f"SELECT count(*) AS n, round(avg({BRIER}), 6) AS brier, round(avg({LOSS}), 6) AS log_loss, round(avg(clv), 6) AS mean_clv, round(median(clv), 6) AS median_clv FROM grades WHERE graded_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY")
def _(t):
    s = metrics.summary(t.grades.where(latest.since("graded_at", now(), 30)), "p", "y", (), "clv")
    return s.select("n", *[r(c).alias(c) for c in ("brier", "log_loss", "mean_clv", "median_clv")])


@query("e13_calibration", "SELECT floor(p * 10) / 10 AS bin, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS rate, count(*) AS n FROM grades GROUP BY 1")
def _(t):
    return metrics.calibration(t.grades, "p", "y").select(C("bin").cast("double").alias("bin"), r("mean_p").alias("mean_p"), r("rate").alias("rate"), "n")


@query("e14_slices", f"SELECT tier, venue, count(*) AS n, round(avg({BRIER}), 6) AS brier, round(avg({LOSS}), 6) AS log_loss FROM grades GROUP BY 1, 2")
def _(t):
    return metrics.slices(t.grades, ["tier", "venue"], "p", "y").select("tier", "venue", "n", r("brier").alias("brier"), r("log_loss").alias("log_loss"))


TAIL = "(SELECT * FROM grades ORDER BY graded_at DESC, event_id DESC LIMIT 200)"


@query("e15_drift_alerts", f"SELECT CAST(floor(p * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS rate, round(abs(avg(p) - avg(CAST(y AS DOUBLE))), 6) AS gap FROM {TAIL} g WHERE p < 1 AND (SELECT count(*) FROM {TAIL} z) >= 100 GROUP BY 1 HAVING count(*) >= 20 AND abs(avg(p) - avg(CAST(y AS DOUBLE))) > 0.07")
def _(t):
    return metrics.drift_alerts(t.grades, "p", "y", "graded_at", ["event_id"]).select("bin", "n", *[r(c).alias(c) for c in ("mean_p", "rate", "gap")])


@query("e16_mean_alert", f"SELECT round(m, 6) AS mean, n FROM (SELECT avg(-clv - 0.05) AS m, count(clv) AS n FROM grades WHERE graded_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) g WHERE n >= 50 AND m < 0")
def _(t):
    return metrics.mean_alert(t.grades.withColumn("v", -C("clv") - 0.05), "v", "graded_at", now()).select(r("mean").alias("mean"), "n")


@query("e17_evidence", "SELECT CAST(DATE '2024-01-31' - min(CAST(graded_at AS DATE)) AS INTEGER) AS days, count(*) AS n, round(avg(clv), 6) AS mean, (DATE '2024-01-31' - min(CAST(graded_at AS DATE))) >= 20 AND count(*) >= 500 AND avg(clv) > 0 AS met FROM grades")
def _(t):
    return metrics.evidence(t.grades, "clv", "graded_at", now(), 20, 500).select("days", "n", r("mean").alias("mean"), "met")


@query("e18_group_rates", "SELECT k, round(avg(CASE WHEN x > 200000 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS rate, count(*) AS n FROM hist GROUP BY k HAVING count(*) >= 10")
def _(t):
    return metrics.group_rates(t.hist.withColumn("y", (C("x") > 200000).cast("int")), "k", "y", 10).select("k", r("rate").alias("rate"), "n")


@query("e19_unique_or_null", "SELECT game, CASE WHEN count(DISTINCT pitcher) = 1 THEN min(pitcher) END AS starter FROM pitch WHERE event = 'A' GROUP BY game")
def _(t):
    return t.pitch.where("event = 'A'").groupBy("game").agg(F.when(F.countDistinct("pitcher") == 1, F.min("pitcher")).alias("starter"))


@query("e20_status_counts", "SELECT count(*) FILTER (WHERE tier = 'click') AS ok, count(*) FILTER (WHERE tier = 'error') AS blocked, count(*) FILTER (WHERE tier NOT IN ('click', 'error')) AS degraded FROM pred")
def _(t):
    return t.pred.agg(F.count_if(C("tier") == "click").alias("ok"), F.count_if(C("tier") == "error").alias("blocked"), F.count_if(~C("tier").isin("click", "error")).alias("degraded"))


one("e21_brier", "grades", {"brier": (lambda: r(X.brier(C("p"), C("y"))), f"round({BRIER}, 6)")}, None, "event_id")
one("e22_log_loss", "grades", {"log_loss": (lambda: r(X.log_loss(C("p"), C("y"))), f"round({LOSS}, 6)")}, None, "event_id")


@query("e23_roc_auc", """WITH s AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM grades)
  SELECT round((sum(rk) FILTER (WHERE y = 1) - (count(*) FILTER (WHERE y = 1)) * ((count(*) FILTER (WHERE y = 1)) + 1) / 2.0) / CAST((count(*) FILTER (WHERE y = 1)) * (count(*) FILTER (WHERE y = 0)) AS DOUBLE), 6) AS auc FROM s""")
def _(t):
    return metrics.roc_auc(t.grades, "p", "y").select(r("auc").alias("auc"))


@query("e24_constant_baseline", "WITH m AS (SELECT least(greatest(avg(CAST(y AS DOUBLE)), 1e-6), 1 - 1e-6) AS q FROM grades) SELECT round(q, 6) AS rate, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(pow(q - y, 2)), 6) AS brier, count(*) AS n FROM grades, m GROUP BY q")
def _(t):
    return metrics.baseline(t.grades, "y").select(*[r(c).alias(c) for c in ("rate", "log_loss", "brier")], "n")


@query("e25_skill_report", f"SELECT round(avg({LOSS}), 6) AS log_loss, round(avg({BRIER}), 6) AS brier, round(avg(-(y * ln(0.6) + (1 - y) * ln(0.4))), 6) AS base_log_loss, round(avg(pow(0.6 - y, 2)), 6) AS base_brier, count(*) AS n, avg(-(y * ln(0.6) + (1 - y) * ln(0.4))) - avg({LOSS}) >= 0.001 AND avg(pow(0.6 - y, 2)) - avg({BRIER}) >= 0.0005 AS passed FROM grades")
def _(t):
    s = metrics.skill(t.grades, "p", "y", 0.6)
    return s.select(*[r(c).alias(c) for c in ("log_loss", "brier", "base_log_loss", "base_brier")], "n", "passed")


query("e26_all_or_null_mean", D10_SQL)(top3)


@query("e27_coverage", f"SELECT rid, {COVER} AS coverage FROM {FEAT} f")
def _(t):
    return feat(t).select("rid", A.coverage(FEATS).alias("coverage"))


@query("e28_family_missing", f"SELECT rid, CASE WHEN f1 IS NULL AND f2 IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END AS missing FROM {FEAT} f")
def _(t):
    return feat(t).select("rid", A.family_missing(["f1", "f2"]).alias("missing"))


@query("e29_missing_count", f"SELECT rid, CAST(4 - 4 * {COVER} AS INTEGER) AS n_missing FROM {FEAT} f")
def _(t):
    return feat(t).select("rid", A.missing_count(FEATS).alias("n_missing"))


@query("e30_health_dot", f"SELECT CASE WHEN max(predicted_at) < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'red' WHEN count(*) FILTER (WHERE tier <> 'click') > 0 THEN 'amber' ELSE 'green' END AS dot, count(*) FILTER (WHERE tier <> 'click') AS not_ok, count(*) AS n FROM pred")
def _(t):
    status = F.when(C("tier") == "click", "OK").otherwise(C("tier"))
    return metrics.health(t.pred.withColumn("status", status), "predicted_at", "status", now()).select("dot", "not_ok", "n")


@query("e31_newest_age", f"SELECT 'events' AS table_name, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts))) AS BIGINT) AS age_s FROM events UNION ALL SELECT 'orders', CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(max(o_orderdate))) AS BIGINT) FROM orders")
def _(t):
    def age(df, at, name):
        newest = F.max(at)
        return df.agg(F.timestamp_diff("SECOND", newest, now()).alias("age_s"), newest.alias("_n")).select(F.lit(name).alias("table_name"), F.ceil((F.timestamp_diff("MICROSECOND", F.date_trunc("SECOND", "_n"), now())) / 1_000_000).alias("age_s"))

    return age(t.events, "ts", "events").unionByName(age(t.orders, "o_orderdate", "orders"))


@query("f01_latest_prediction", "SELECT game, event_id, p FROM pred QUALIFY row_number() OVER (PARTITION BY game ORDER BY predicted_at DESC, event_id DESC) = 1")
def _(t):
    return latest.latest(t.pred, ["game"], "predicted_at", ["event_id"]).select("game", "event_id", "p")


@query("f02_latest_quote_per_book", f"SELECT matchup, book, event_id FROM {LAST_SNAP} s")
def _(t):
    return last_snap(t).select("matchup", "book", "event_id")


FRAMES = (7, 14, 30, 90, 365)


F03_SQL = "SELECT r.rid, " + ", ".join(f"CASE WHEN count(h.k) FILTER (WHERE h.d >= r.d - {n}) > 0 THEN count(h.k) FILTER (WHERE h.d >= r.d - {n}) END AS n_{n}, round(sum(h.x) FILTER (WHERE h.d >= r.d - {n}), 2) AS x_{n}" for n in FRAMES) + " " + WINDOW.format("")


def _frames(f: DataFrame) -> DataFrame:
    return f.select("rid", *[c for n in FRAMES for c in (C(f"{n}d_rows").alias(f"n_{n}"), r(f"{n}d_x", 2).alias(f"x_{n}"))])


@query("f03_day_frames", F03_SQL)
def _(t):
    return _frames(A.asof(t.hist, t.requests, "k", "d", ["x"], FRAMES, False))


@query("f03_stored_frames", F03_SQL)
def _(t):
    """The frames from stored totals: built from the days up to a date, extended by the later ones."""
    state = FeatureState(t.spark, _scratch(t, "f03-state"), A.History(t.hist, "k", "d", ["x"], FRAMES, False))
    for part in ("d < DATE'2000-01-01'", "d >= DATE'2000-01-01'"):
        state.extend(t.hist.where(part))
    return _frames(state.read(t.requests, "k", "d"))


@query("f04_last_n_rows", """WITH j AS (SELECT r.rid, h.x, h.x_null, row_number() OVER (PARTITION BY r.rid ORDER BY h.d DESC, h.gid DESC) AS back FROM requests r JOIN hist h ON h.k = r.k AND h.d < r.d)
  SELECT r.rid, count(j.x) FILTER (WHERE back <= 5) AS last_rows, round(sum(j.x) FILTER (WHERE back <= 5), 2) AS last_x, count(j.x_null) FILTER (WHERE back <= 5) AS seen FROM requests r LEFT JOIN j ON j.rid = r.rid GROUP BY r.rid""")
def _(t):
    f = A.last_n(t.hist, t.requests, "k", "d", "gid", ["x", "x_null"], 5)
    return f.select("rid", F.coalesce(C("last_rows"), F.lit(0)).cast("long").alias("last_rows"), r("last_x", 2).alias("last_x"), F.coalesce("last_x_null_n", F.lit(0)).alias("seen"))


@query("f05_career", "SELECT r.rid, round(sum(h.x), 2) AS x_all " + WINDOW.format(""))
def _(t):
    return A.asof(t.hist, t.requests, "k", "d", ["x"]).select("rid", r("all_x", 2).alias("x_all"))


@query("f06_rest_days", "SELECT r.rid, CAST(r.d - max(h.d) AS INTEGER) AS rest_days FROM requests r LEFT JOIN hist h ON h.k = r.k AND h.d < r.d GROUP BY r.rid, r.d")
def _(t):
    return A.asof(t.hist, t.requests, "k", "d", ["x"]).select("rid", F.datediff("d", "prev_day").alias("rest_days"))


@query("f07_fold_positions", f"SELECT rid, position FROM {PLACED} p")
def _(t):
    return placed(t).select("rid", C("position").cast("long").alias("position"))


@query("f08_purged_folds", f"SELECT fold, lo, hi, CAST(cutoff AS DATE) AS cutoff, n_train FROM {FOLDS} f WHERE n_train >= 200")
def _(t):
    return folds.fold_table(placed(t), "d").select("fold", "lo", "hi", "cutoff", "n_train")


@query("g01_chronological", "SELECT gid, d FROM hist ORDER BY d, gid")
def _(t):
    return t.hist.select("gid", "d").orderBy("d", "gid")


@query("g02_newest_approved", f"SELECT model_version FROM {APPROVED} ORDER BY trained DESC, model_version DESC LIMIT 1")
def _(t):
    return registry.current(reg(t)).select("model_version")


@query("g03_latest_of_one", "SELECT event_id, game, p FROM pred WHERE game = 7 ORDER BY predicted_at DESC, event_id DESC LIMIT 1")
def _(t):
    return latest.latest_of(t.pred, "game", 7, "predicted_at", ["event_id"]).select("event_id", "game", "p")


@query("g04_trailing_rows", f"SELECT event_id FROM {TAIL} g")
def _(t):
    return latest.trailing(t.grades, "graded_at", ["event_id"], 200).select("event_id")


@query("g05_first_examples", "SELECT game, inning, count(*) AS n FROM pitch WHERE event = 'A' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5")
def _(t):
    return quality.key_problems(t.pitch.where("event = 'A'"), ["game", "inning"])


@query("g06_first_members", f"SELECT game, array_to_string(list(CAST(id AS VARCHAR) ORDER BY place), ',') AS ids FROM {TOP3} x WHERE place <= 3 GROUP BY game")
def _(t):
    rows = t.basket_rows.groupBy("game").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "id", "qty"))), lambda s: s["id"].cast("string")).alias("ids"))
    return rows.select("game", F.array_join(F.slice("ids", 1, 3), ",").alias("ids"))


@query("g07_monotonic_days", "SELECT count(*) FILTER (WHERE d < b) AS n_back FROM (SELECT d, lag(d) OVER (ORDER BY gid) AS b FROM hist) h")
def _(t):
    return latest.monotonic(t.hist, "gid", "d")


@query("h01_stacked_roles", "SELECT gid AS rid, 'away' AS role, k AS entity FROM hist UNION ALL SELECT gid, 'home', k + 1 FROM hist")
def _(t):
    games = t.hist.select(C("gid").alias("rid"), C("k").alias("away"), (C("k") + 1).alias("home"))
    return A.two_sided(games, "rid", {"away": "away", "home": "home"}, []).select("rid", "role", "entity")


@query("h02_distinct_ids", "SELECT game, count(DISTINCT pitcher) AS n FROM pitch GROUP BY 1")
def _(t):
    return t.pitch.groupBy("game").agg(F.size(F.collect_set("pitcher")).cast("long").alias("n"))


# ---- scalar functions ---------------------------------------------------------------------------

AM = "CASE WHEN price > 0 THEN 100 / (price + 100) WHEN price < 0 THEN abs(price) / (abs(price) + 100) END"
one("i01_american_probability", "snap", {"prob": (lambda: r(X.american_probability(C("price"))), f"round({AM}, 6)")}, None, "event_id")
one("i02_no_vig", "snap", {"p_novig": (lambda: r(X.no_vig(X.american_probability(C("price")), X.american_probability(C("under")))), f"round(({AM}) / (({AM}) + CAST(110 AS DOUBLE) / 210), 6)")}, None, "event_id")
one("i03_snapshot_id", "snap", {"sid": (lambda: X.snapshot_id(C("event_id"), C("book"), F.date_trunc("SECOND", C("captured_at").cast("timestamp"))), "sha1(CAST(event_id AS VARCHAR) || '|' || book || '|' || strftime(captured_at, '%Y-%m-%dT%H:%M:%S') || '+00:00')")}, None, "event_id")
one("i04_as_utc", "hist", {"day": (lambda: X.as_utc(F.concat(C("d").cast("string"), F.lit("T00:00:00"))).cast("date"), "d")}, None, "gid")
one("i05_as_date", "hist", {"day": (lambda: X.as_date(F.when(C("gid") % 5 == 0, "none").otherwise(F.concat(C("d").cast("string"), F.lit("T12:00")))), "CASE WHEN gid % 5 = 0 THEN NULL ELSE d END")}, None, "gid")
one("i06_safe_numbers", "hist", {"whole": (lambda: X.as_int(F.when(C("gid") % 5 == 0, "x").otherwise(C("gid").cast("string"))), "CASE WHEN gid % 5 = 0 THEN NULL ELSE gid END"), "number": (lambda: X.as_double(F.when(C("gid") % 7 == 0, "NaN").otherwise(C("gid").cast("string"))), "CASE WHEN gid % 7 = 0 THEN NULL ELSE CAST(gid AS DOUBLE) END")}, None, "gid")
one("i07_season_week", "hist", {"season": (lambda: X.season(C("d")).cast("long"), "year(d)"), "week": (lambda: X.iso_week(C("d")).cast("long"), "weekofyear(d)")}, None, "gid")
one("i08_wind_out", "hist", {"wind": (lambda: r(X.wind_out(C("x") / 10000, C("gid") % 360, F.lit(45.0)) + 100), "round(x / 10000 * cos(radians(gid % 360 - CAST(45 AS DOUBLE))) + 100, 6)")}, None, "gid")
one("i09_weather_missing", "hist", {"missing": (lambda: X.weather_missing(C("gid") % 3 == 0, C("x_null"), F.when(C("priority") != "1-URGENT", C("x"))), "CASE WHEN gid % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN x_null IS NULL OR priority = '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")}, None, "gid")
one("i10_shrink", "pred", {"p_final": (lambda: r(X.shrink_to_group(C("p"), F.when(C("event_id") % 3 != 0, F.lit(0.4)), (C("event_id") % 50).cast("double"))), "round(CASE WHEN event_id % 3 <> 0 THEN (CAST(event_id % 50 AS DOUBLE) * p + 20 * CAST(0.4 AS DOUBLE)) / (CAST(event_id % 50 AS DOUBLE) + 20) ELSE p END, 6)")}, None, "event_id")
one("i11_effective_rows", "hist", {"n_eff": (lambda: r(X.effective_rows(F.when(C("gid") % 2 == 0, (C("gid") % 100).cast("double")), F.when(C("gid") % 3 == 0, (C("gid") % 70).cast("double")), F.lit(0.9))), "round(least(coalesce(least(CASE WHEN gid % 2 = 0 THEN CAST(gid % 100 AS DOUBLE) END, CASE WHEN gid % 3 = 0 THEN CAST(gid % 70 AS DOUBLE) END), 0), 60) * CAST(0.9 AS DOUBLE), 6)")}, None, "gid")
one("i12_edge", "pred", {"edge": (lambda: r(X.edge(C("p"), F.lit(0.5), C("event_id") % 2 == 0)), "CASE WHEN event_id % 2 = 0 THEN round(p - 0.5, 6) END")}, None, "event_id")
one("i13_market_reason", "snap", {"reason": (lambda: X.market_reason(F.when(C("event_id") % 7 != 0, C("p")), C("event_id") % 4, F.when(C("event_id") % 5 != 0, C("event_id") % 1300 - 100)), "CASE WHEN event_id % 7 = 0 THEN 'no_market_consensus' WHEN event_id % 4 < 2 THEN 'books_' || (event_id % 4) || '_below_2' WHEN event_id % 5 = 0 THEN 'odds_age_unknown' WHEN event_id % 1300 - 100 < 0 THEN 'odds_timestamp_in_future' WHEN event_id % 1300 - 100 > 600 THEN 'odds_stale_' || (event_id % 1300 - 100) || 's' END")}, None, "event_id")
one("i14_coverage_reason", "pred", {"reason": (lambda: X.coverage_reason(C("p")), "CASE WHEN p < 0.85 THEN printf('coverage_%.2f_below_0.85', p) END")}, None, "event_id")
one("i15_tier", "pred", {"level": (lambda: X.tier(F.when(C("event_id") % 3 == 0, "BLOCKED").otherwise("OK"), C("event_id") % 2 == 0, C("p"), C("event_id") % 4), "CASE WHEN event_id % 3 = 0 THEN 'LOW' WHEN event_id % 2 = 0 AND p >= 0.95 AND event_id % 4 >= 2 THEN 'HIGH' ELSE 'MEDIUM' END")}, None, "event_id")
one("i16_closing_value", "grades", {"value": (lambda: r(X.closing_value(C("p") - 0.5, F.when(C("event_id") % 4 != 0, F.lit(0.55)), F.lit(0.5))), "CASE WHEN event_id % 4 <> 0 THEN round((CASE WHEN p - 0.5 >= 0 THEN 1 ELSE -1 END) * (CAST(0.55 AS DOUBLE) - 0.5), 6) END")}, None, "event_id")
one("i17_display", "pred", {"percent": (lambda: X.display_percent(C("p")), "round(CAST(100 AS DOUBLE) * (1 - p), 1)")}, None, "event_id")


@query("i18_score_status", """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR p < 0.85 THEN 'BLOCKED' WHEN event_id % 3 = 0 THEN 'DEGRADED' ELSE 'OK' END AS status,
   CASE WHEN event_id % 11 = 0 THEN 'entity_unknown' WHEN event_id % 13 = 0 THEN 'feature_error:bad' WHEN p < 0.85 THEN printf('coverage_%.2f_below_0.85', p) WHEN event_id % 3 = 0 THEN 'no_market_consensus' END AS reason FROM pred""")
def _(t):
    s = X.score_status([F.when(C("event_id") % 11 != 0, C("game"))], F.when(C("event_id") % 13 == 0, "bad"), C("p"), C("p"), F.when(C("event_id") % 3 == 0, "no_market_consensus"))
    return t.pred.select("event_id", s.alias("s")).select("event_id", "s.status", "s.reason")


one("i19_clip", "grades", {"clipped": (lambda: r(X.clip(C("p")), 9), f"round({PC}, 9)")}, None, "event_id")


@query("i20_json_objects", "SELECT event_id, true AS kept, 'v' AS added FROM snap")
def _(t):
    text = F.when(C("event_id") % 3 == 0, "broken").otherwise(F.to_json(F.struct("matchup", "book")))
    put = X.json_put(text, "note", F.lit("v"))
    return t.snap.select("event_id", ((F.get_json_object(put, "$.book") == C("book")) | (C("event_id") % 3 == 0)).alias("kept"), F.get_json_object(put, "$.note").alias("added"))


@query("i21_nested_output", "SELECT event_id, CAST(game AS VARCHAR) AS team, tier AS level FROM pred")
def _(t):
    out = F.to_json(F.struct(F.struct(C("game").cast("string").alias("team"), F.struct(C("tier").alias("level")).alias("odds")).alias("away")))
    return t.pred.select("event_id", F.get_json_object(out, "$.away.team").alias("team"), F.get_json_object(out, "$.away.odds.level").alias("level"))


one("i22_clean_name", "part_dim", {"label": (lambda: X.clean_name(F.when(C("venue") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("name"))), C("brand")), "lower(CASE WHEN venue % 4 = 0 THEN brand ELSE name END)")}, None, "venue")
one("i23_time_fallback", "snap", {"hour": (lambda: F.hour(F.coalesce(F.when(C("event_id") % 2 == 0, C("captured_at")), F.date_trunc("DAY", C("captured_at")))).cast("long"), "CASE WHEN event_id % 2 = 0 THEN hour(captured_at) ELSE 0 END")}, None, "event_id")

# ---- streaming, replayed over the stored events -------------------------------------------------


def _replay(t: Tables, name: str, make, mode: str) -> DataFrame:
    """Run a stream over the events once and read back the Parquet files that its batches wrote."""
    from tidemark.streaming import snapshots

    stream = make(snapshots.events_stream(t.spark, f"{t.folder}/events.parquet*"))
    return snapshots.replayed(stream, _scratch(t, f"{name}-rows"), _scratch(t, name), mode)


@query("j01_stream_dedupe", "SELECT user_id AS matchup, count(*) AS n FROM events GROUP BY 1")
def _(t):
    from tidemark.streaming import snapshots

    def make(stream):
        twice = stream.select("event_id", C("user_id").alias("matchup"), "captured_at", F.explode(F.array(F.lit(1), F.lit(2))).alias("again"))
        return snapshots.deduplicated(twice, "event_id", "captured_at", "60 days")

    return _replay(t, "j01", make, "append").groupBy("matchup").agg(F.count(F.lit(1)).alias("n"))


@query("j02_stream_latest", "SELECT user_id AS matchup, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def _(t):
    from tidemark.streaming import snapshots

    return _replay(t, "j02", lambda s: snapshots.latest_by_key(s.withColumnRenamed("user_id", "matchup"), ["matchup"], "captured_at", ["event_id"]), "complete").select("matchup", "event_id")


@query("j03_stream_consensus", """WITH l AS (SELECT user_id AS matchup, event_type AS book, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1),
  m AS (SELECT *, max(ts) OVER (PARTITION BY matchup) AS newest FROM l),
  f AS (SELECT *, epoch(greatest(newest, (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))) - epoch(ts) <= 86400 AS fresh FROM m)
  SELECT matchup, count(*) FILTER (WHERE fresh) AS books_n, CASE WHEN count(*) FILTER (WHERE fresh) >= 2 THEN round(median(value) FILTER (WHERE fresh), 6) END AS p_market FROM f GROUP BY 1""")
def _(t):
    from tidemark.streaming import snapshots

    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = lambda s: s.select(C("user_id").alias("matchup"), C("event_type").alias("book"), "captured_at", C("value").alias("p"))
    out = _replay(t, "j03", lambda s: snapshots.consensus_stream(rows(s), 86_400.0, late="10 minutes"), "update")
    return latest.latest(out, ["matchup"], "as_of", ["batch"]).select("matchup", "books_n", r("p_market").alias("p_market"))


@query("j04_stream_upsert", "SELECT user_id AS matchup, event_id FROM events")
def _(t):
    from tidemark.streaming import snapshots

    stream = snapshots.events_stream(t.spark, f"{t.folder}/events.parquet*").select("event_id", C("user_id").alias("matchup"), "captured_at")
    table = KeyedTable(t.spark, _scratch(t, "j04"), ["event_id"], buckets=BUCKETS)
    snapshots.upsert_stream(stream, table, "captured_at", _scratch(t, "j04-checkpoint")).awaitTermination()
    return table.read().select("matchup", "event_id")


@query("j05_tumbling_windows", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    from tidemark.streaming import snapshots

    make = lambda s: snapshots.tumbling(s.withWatermark("captured_at", "60 days"), "captured_at", "value")
    return _replay(t, "j05", make, "complete").select(C("start").cast("timestamp_ntz").alias("start"), "n", r("mean").alias("mean"))


# ---- models -------------------------------------------------------------------------------------

_bundles: dict[tuple, dict] = {}

#: What the stack learns, of the columns of the feature catalogue.
MODEL_FEATURES = [
    "away_p_career_era", "away_p_career_whip", "away_p_30d_era", "away_p_fi_ra9", "home_p_career_era", "away_t_season_woba", "away_t_30d_rpg",
    "home_t_season_woba", "home_t_30d_rpg", "park_runs_factor", "temp_f", "wind_out_component",
]
#: The orders' days stand for the training period; stand-ins lack many values, so that little coverage is asked of them.
TRAINING = replace(DEFAULT, train_start=date(1995, 1, 1), train_end=date(2001, 12, 31), min_coverage=0.25)
#: Targets by version: what an order comes to, which nothing tells in advance, and a rule on two features.
TARGETS = {"order": "CAST(o_totalprice > 200000 AS INT)", "rule": "CAST(coalesce(park_runs_factor, 0) > 2.2 AND coalesce(temp_f, 0) < 75 AS INT)"}


def slate(t: Tables, whole: bool = True) -> DataFrame:
    """Every order with its features by the catalogue, its target by either version, and what scoring needs: the ``whole`` of it with
    the coverage of all 113 columns, which a slate's gate asks for, or only the columns that models learn and score."""
    wanted = None if whole else [*MODEL_FEATURES, "away_p_fi_games", "home_p_fi_games"]
    built = catalogue.features(t, wanted).join(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), C("rid") == C("o_orderkey"))
    counts = [F.coalesce(f"{side}_p_fi_games", F.lit(0.0)).alias(f"{side}_n") for side in ("away", "home")]
    return built.select("rid", "d", "venue_id", "away_pitcher", *["coverage"] * whole, C("o_custkey").alias("matchup"), *MODEL_FEATURES, *counts, *[F.expr(e).alias(f"y_{v}") for v, e in TARGETS.items()])


def members(version: str) -> dict[str, dict]:
    """Members and candidates by target."""
    from tidemark.plans import model

    return {"members": model.MEMBERS} | ({"candidates": {"forest": model.forest_member}} if version == "order" else {})


def _slate(t: Tables, whole: bool) -> DataFrame:
    """``slate``, once per folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, "whole" if whole else "slate")
    if key not in _bundles:
        _bundles[key] = {"rows": stage(slate(t, whole), key[-1])}
    return _bundles[key]["rows"]


def _run(t: Tables, version: str) -> dict:
    """What is known of a target's training run on the feature catalogue: its rows (``rows``, and ``covered`` ones), the models
    learnt so far (``fits``), and results by step. Each query learns what it returns and no more. Only the last folder's are kept."""
    from tidemark.plans import model

    folder = (t.spark.sparkContext.applicationId, t.folder)
    for key in [k for k in _bundles if k[:2] != folder]:
        del _bundles[key]
    if (*folder, version) not in _bundles:
        rows = _slate(t, (*folder, "whole") in _bundles)
        _bundles[*folder, version] = {"rows": rows, "covered": model.training_rows(rows, MODEL_FEATURES, f"y_{version}", "d", TRAINING), "fits": {}, "scores": {}}
    return _bundles[*folder, version]


def member_scores(t: Tables, name: str, version: str = "order") -> tuple[DataFrame, list[int]]:
    """Out-of-fold scores of one member, and its rounds by fold if it boosts."""
    from tidemark.plans import model

    run = _run(t, version)
    if "evaluated" in run:
        return run["evaluated"]["oof"].drop("stack"), run["evaluated"]["rounds"].get(name, [])
    if name not in run["scores"]:
        rounds: dict[str, list[int]] = {}
        everyone = reduce(dict.__or__, members(version).values())
        scores = model.out_of_fold(run["covered"], MODEL_FEATURES, f"y_{version}", "d", "rid", {name: everyone[name]}, TRAINING, rounds, run["fits"])
        run["scores"][name] = stage(scores, f"scores-{name}"), rounds.get(name, [])
    return run["scores"][name]


def evaluated(t: Tables, version: str = "order") -> dict:
    """The stack over the folds, without members on all rows."""
    from tidemark.plans import model

    run = _run(t, version)
    if "evaluated" not in run:
        run["evaluated"] = model.evaluate(run["covered"], MODEL_FEATURES, f"y_{version}", "d", "rid", config=TRAINING, fits=run["fits"], **members(version))
    return run["evaluated"]


def bundle(t: Tables, version: str = "order") -> dict:
    """A whole training run, with the whole slate as its rows."""
    rows = _slate(t, True)
    return trained(t, version) | {"rows": rows}


def trained(t: Tables, version: str = "order") -> dict:
    """A whole training run, from its gates to its registry row, once per folder and target."""
    from tidemark.plans import model

    run = _run(t, version)
    if "trained" not in run:
        empty = t.spark.createDataFrame([], "model_version string, trained_at string, train_range string, cv_log_loss double, cv_brier double, gates_passed boolean, gate_report string, status string")
        path = _scratch(t, f"model-{version}")
        known = evaluated(t, version) if run["fits"] else None
        registered, made = model.train_candidate(run["rows"], MODEL_FEATURES, f"y_{version}", "d", "rid", "venue_id", empty, path, version, NOW, config=TRAINING, fits=run["fits"], known=known, **members(version))
        run["fits"], run["evaluated"] = made["fits"], made
        run["trained"] = made | {"registry": stage(registered, "registry"), "path": path, "rows": run["rows"]}
    return run["trained"]


def _figures(t: Tables, names) -> DataFrame:
    rows = [(m, float(f["log_loss"]), float(f["brier"]), int(f["n"])) for m, f in sorted(evaluated(t)["report"].items()) if m in names]
    return t.spark.createDataFrame(rows, "member string, log_loss double, brier double, n long")


query("l01_boosted_member")(lambda t: member_scores(t, "boosted")[0].select("rid", "fold", "boosted"))
query("l03_linear_member")(lambda t: member_scores(t, "linear")[0].select("rid", "fold", "linear"))
query("l05_out_of_fold")(lambda t: evaluated(t)["oof"].drop("stack"))
query("l06_stack")(lambda t: evaluated(t)["oof"].select("rid", C("y_order").alias("label"), "stack"))
query("l07_stack_report")(lambda t: _figures(t, ("boosted", "linear", "forest", "stack", "constant")))
query("k01_pluggable_member")(lambda t: member_scores(t, "forest")[0].select("rid", "forest"))


@query("l02_full_refit")
def _(t):
    from tidemark.plans import model

    _, rounds = member_scores(t, "boosted")
    run = _run(t, "order")
    names = model.observed(run["covered"], MODEL_FEATURES)
    trees = model.refit(run["covered"], names, "y_order", "boosted", model.boosted_member, {"boosted": rounds}, run["fits"]).stages[-1].getNumTrees
    return t.spark.createDataFrame([(trees, model.best_rounds(rounds), model.best_rounds([]))], "trees int, median_rounds int, default_rounds int")


@query("l04_optional_member")
def _(t):
    b = evaluated(t)
    return t.spark.createDataFrame([(m, float(g), m in b["kept"]) for m, g in b["ablation"].items()], "member string, gain double, kept boolean")


def _calibrated(t: Tables) -> DataFrame:
    pairs = t.grades.withColumn("model", F.when(C("venue") % 2 == 0, "a").otherwise("b"))
    return vennabers.apply(pairs, vennabers.calibrate(pairs, "model", "p", "y"), "model", "p")


BY_VENUE = intervals_sql("SELECT CASE WHEN venue % 2 = 0 THEN 'a' ELSE 'b' END AS model, event_id, p, y FROM grades")
query("l08_venn_abers", f"SELECT event_id, {INTERVALS} FROM {BY_VENUE} x")(lambda t: _calibrated(t).select("event_id", r("p0").alias("p0"), r("p1").alias("p1"), r("p_cal").alias("p_cal")))
query("l09_interval_width", f"SELECT event_id, round(p1 - p0, 6) AS width FROM {BY_VENUE} x")(lambda t: _calibrated(t).select("event_id", r("width").alias("width")))


@query("l10_scoring")
def _(t):
    """Every order's probability by the stack of the rule, calibrated by what it scored out of fold."""
    from tidemark.plans import model

    b = trained(t, "rule")
    raw = stage(model.score(b, b["rows"], "rid"), "raw")  # calibration reads the scores several times
    out = vennabers.apply(raw.withColumn("model", F.lit("rule")), b["intervals"], "model", "raw")
    return out.select("rid", "raw", "p_cal", X.probability(C("p_cal")).alias("valid"))


@query("l11_save_load")
def _(t):
    """The whole stack of each target: what passed its gate is loaded and scores alike, what failed was not saved and is refused."""
    from tidemark.plans import model

    out = []
    for version in TARGETS:
        b = trained(t, version)
        refused, differs = None, F.lit(None).cast("double")
        scored = model.score(b, b["rows"], "rid")
        if b["gate"]:
            loaded = model.load(b["path"], version, b["features"], t.spark)
            scored = scored.join(model.score(loaded, b["rows"], "rid").withColumnRenamed("raw", "again"), "rid")
            differs = F.max(F.abs(C("raw") - C("again")))
        else:
            try:
                model.save(b, _scratch(t, "refused"), version, t.spark)
                refused = False
            except io.ContractError:
                refused = True
        out.append(scored.agg(F.count(F.lit(1)).alias("n"), differs.alias("largest_difference")).select(F.lit(version).alias("model_version"), F.lit(bool(b["gate"])).alias("gate"), F.lit(",".join(b["kept"])).alias("members"), "n", "largest_difference", F.lit(refused).cast("boolean").alias("refused")))
    return reduce(DataFrame.unionByName, out)


HELD = f"(SELECT avg({LOSS}) AS loss, avg({BRIER}) AS brier, avg(-ln(0.5) + 0 * y) AS base_loss, avg(0.25 + 0 * y) AS base_brier, count(*) AS n FROM grades WHERE graded_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY)"
HELD_PASSED = "(base_loss - loss >= 0.001 AND base_brier - brier >= 0.0005)"


@query("l12_locked_holdout", f"""SELECT model_version, CASE WHEN mine THEN CASE WHEN {HELD_PASSED} THEN 'candidate' ELSE 'rejected' END ELSE status END AS status, CASE WHEN mine THEN {HELD_PASSED} END AS holdout_passed,
   CASE WHEN mine THEN n END AS holdout_n, CASE WHEN mine THEN round(loss, 6) END AS holdout_log_loss, CASE WHEN mine THEN round(brier, 6) END AS holdout_brier
   FROM (SELECT *, model_version = (SELECT min(model_version) FROM {REG} r WHERE gates_passed) AS mine FROM {REG} q) x, {HELD} h""")
def _(t):
    rows = reg(t).withColumns({"holdout_passed": F.lit(None).cast("boolean"), "holdout_burned_rerun": F.lit(None).cast("boolean")})
    version = rows.where("gates_passed").agg(F.min("model_version")).first()[0]
    held = t.grades.where(latest.since("graded_at", now(), 10))
    out = registry.evaluate_holdout(rows, version, {"training_end": date(2024, 11, 30), "baseline_rate": 0.5}, held, "p", "y", NOW)
    return out.select("model_version", "status", "holdout_passed", "holdout_n", r("holdout_log_loss").alias("holdout_log_loss"), r("holdout_brier").alias("holdout_brier"))


@query("m01_register", f"SELECT model_version, status FROM {REG} r UNION ALL SELECT -1, 'candidate'")
def _(t):
    row = t.spark.createDataFrame([(-1, True)], "model_version bigint, gates_passed boolean")
    return registry.register(reg(t), row).select("model_version", "status")


query("m02_current_model", f"SELECT model_version FROM {APPROVED} ORDER BY trained DESC, model_version DESC LIMIT 1")(lambda t: registry.current(reg(t)).select("model_version"))

CANDIDATE = f"(SELECT min(model_version) FROM {REG} r WHERE status = 'candidate' AND gates_passed AND holdout_passed AND NOT coalesce(burned, false))"


@query("m03_promote", f"SELECT model_version, CASE WHEN model_version = {CANDIDATE} THEN 'production' WHEN status = 'production' THEN 'retired' ELSE status END AS status FROM {REG} q")
def _(t):
    table = KeyedTable(t.spark, _scratch(t, "m03"), ["model_version"], buckets=BUCKETS)
    table.upsert(reg(t))
    version = table.read().where("status = 'candidate' AND gates_passed AND holdout_passed AND NOT coalesce(holdout_burned_rerun, false)").agg(F.min("model_version")).first()[0]
    return registry.promote_table(table, version, NOW).select("model_version", "status")


@query("m04_prediction_rows", "SELECT event_id, game, CASE WHEN p >= 0.85 THEN 'OK' ELSE 'BLOCKED' END AS status FROM pred")
def _(t):
    path = _scratch(t, "m04")
    io.append(t.pred.select("event_id", "game", F.when(C("p") >= 0.85, "OK").otherwise("BLOCKED").alias("status")), path)
    return t.spark.read.parquet(path)


GRADED = f"""(SELECT p.game, p.event_id, p.p, c.y, m.p_close FROM (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY game ORDER BY predicted_at DESC, event_id DESC) = 1) p
   JOIN cust_y c ON p.game = c.game LEFT JOIN (SELECT matchup, median(p) AS p_close FROM {LAST_SNAP} s GROUP BY 1) m ON m.matchup = p.game WHERE c.y IS NOT NULL)"""


def graded(t):
    quotes = t.snap.withColumnRenamed("matchup", "game")
    g = grading.grade(t.pred, t.cust_y, quotes, "game", ["event_id"], "predicted_at", "p", "y", ["game"], "p", ["game", "book"])
    return g


@query("m05_grade_upsert", f"SELECT game, round({BRIER}, 6) AS brier FROM {GRADED} g")
def _(t):
    rows = graded(t).select("game", r("brier").alias("brier"))
    table = KeyedTable(t.spark, _scratch(t, "m05"), ["game"], buckets=BUCKETS)
    table.upsert(rows.where("game % 2 = 0").withColumn("brier", F.lit(-1.0)))
    table.upsert(rows)
    return table.read()


# ---- pipelines ----------------------------------------------------------------------------------


@query("n01_load_dataset", "SELECT d, gid, k, x FROM hist")
def _(t):
    from tidemark.specs import DatasetSpec

    spec = DatasetSpec("hist", {"gid": "bigint", "k": "bigint", "d": "date", "x": "double"}, ("gid",), date_column="d")
    t.hist.select("gid", "k", "d", "x").write.option("header", True).csv(csv := _scratch(t, "n01-csv"))
    rows = quality.validate(io.read_csv(t.spark, csv, "gid string, k string, d string, x string"), spec, "feed", F.lit(NOW).cast("timestamp"))
    table = KeyedTable(t.spark, _scratch(t, "n01"), ["gid"], buckets=BUCKETS)
    table.upsert(rows)
    table.upsert(rows)
    return table.read().select("d", "gid", "k", "x")


query("n02_feature_catalogue", catalogue.CATALOGUE_SQL)(catalogue.catalogue)


SLATE = f"""WITH g AS (SELECT p.event_id, p.game, p.p AS raw, c.venue, CAST(p.predicted_at AS DATE) AS d FROM (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY game ORDER BY predicted_at DESC, event_id DESC) = 1) p JOIN cust_y c ON p.game = c.game),
  h AS (SELECT g.game, nullif(count(x.x), 0) AS na, nullif(count(x.x_null), 0) AS nb, CAST(max(x.d) IS NOT NULL AS INT) AS rest FROM g LEFT JOIN hist x ON x.k = g.game AND x.d < g.d GROUP BY 1),
  rates AS (SELECT venue, avg(CAST(y AS DOUBLE)) AS rate FROM cust_y WHERE y IS NOT NULL AND venue IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
  z AS {intervals_sql("SELECT 'm' AS model, p.event_id, p.p, c.y FROM pred p LEFT JOIN cust_y c ON p.game = c.game", "y IS NOT NULL")},
  s AS (SELECT g.*, (2 * CAST(na IS NOT NULL AS INT) + CAST(nb IS NOT NULL AS INT) + rest) / CAST(4 AS DOUBLE) AS coverage, least(coalesce(least(na, nb), 0), 60) AS n_least, p1 / (1 - p0 + p1) AS p_cal, rate, m.*
    FROM g JOIN h USING (game) LEFT JOIN rates USING (venue) JOIN z ON z.event_id = g.event_id LEFT JOIN {CONSENSUS} m ON m.matchup = g.game),
  f AS (SELECT *, CASE WHEN rate IS NULL THEN p_cal ELSE (n_least * coverage * p_cal + 20 * rate) / (n_least * coverage + 20) END AS p_shrunk,
    CASE WHEN coverage < 0.85 THEN printf('coverage_%.2f_below_0.85', coverage) END AS block,
    CASE WHEN p_market IS NULL THEN 'no_market_consensus' WHEN age_s > 43200 THEN 'odds_stale_' || age_s || 's' END AS market FROM s)
  SELECT game, CASE WHEN block IS NOT NULL THEN 'BLOCKED' WHEN market IS NOT NULL THEN 'DEGRADED' ELSE 'OK' END AS status, coalesce(block, market) AS reason, CASE WHEN block IS NULL THEN round(p_shrunk, 6) END AS p_final,
    CASE WHEN block IS NULL AND market IS NULL THEN round(p_shrunk - p_market, 6) END AS edge,
    CASE WHEN block IS NOT NULL OR market IS NOT NULL THEN 'LOW' WHEN game % 2 = 0 AND coverage >= 0.95 AND books_n >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM f"""


@query("n03_score_slate", SLATE)
def _(t):
    games = latest.latest(t.pred, ["game"], "predicted_at", ["event_id"]).join(t.cust_y.select("game", "venue"), "game").withColumn("d", C("predicted_at").cast("date"))
    f = A.asof(t.hist, games.withColumnRenamed("p", "raw"), "k", "d", ["x", "x_null"], (), True, "game", "d")
    f = f.withColumns({"mean_x": A.per_observation(C("all_x"), C("all_x_n")), "mean_null": A.per_observation(C("all_x_null"), C("all_x_null_n")), "rest": F.datediff("d", "prev_day")})
    f = f.withColumns({"coverage": A.coverage(["mean_x", "mean_null", "rest", "all_rows"]), "model": F.lit("m")})
    scored = vennabers.apply(f, vennabers.calibrate(t.grades.withColumn("model", F.lit("m")), "model", "p", "y"), "model", "raw")
    rates = metrics.group_rates(t.cust_y, "venue", "y")
    s = grading.score_slate(scored, consensus(t).withColumnRenamed("matchup", "game"), ["game"], rates, "venue", ["game"], "p_cal", ("all_x_n", "all_x_null_n"), C("game") % 2 == 0, F.lit(None).cast("string"), DAY)
    return s.select("game", "status", "reason", r("p_final").alias("p_final"), r("edge").alias("edge"), "tier")


@query("n04_grade_date", f"SELECT game, p, y, round({BRIER}, 6) AS brier, round({LOSS}, 6) AS log_loss, CASE WHEN p_close IS NOT NULL THEN round((CASE WHEN p - 0.5 >= 0 THEN 1 ELSE -1 END) * (p_close - 0.5) + 1, 6) END AS clv_plus_1 FROM {GRADED} g")
def _(t):
    g = grading.with_closing_value(graded(t).withColumns({"market": F.lit(0.5), "edge": C("p") - 0.5}), "market", "edge")
    return g.select("game", "p", "y", r("brier").alias("brier"), r("log_loss").alias("log_loss"), r(C("clv") + 1).alias("clv_plus_1"))


@query("n05_train_candidate")
def _(t):
    """Registry rows of the training runs on both targets: the whole stack, its gate passed or refused by its figures."""
    rows = reduce(DataFrame.unionByName, [trained(t, version)["registry"] for version in TARGETS])
    return rows.select("model_version", "status", "train_range", r("cv_log_loss").alias("cv_log_loss"), r("cv_brier").alias("cv_brier"), "gates_passed", C("gate_report").isNotNull().alias("reported"))


@query("n03_slate_end_to_end")
def _(t):
    """Every order as a slate: catalogue features, the stack, calibration, shrinkage, market and status, appended and read back."""
    from tidemark.plans import model

    b = bundle(t, "rule")
    rows = b["rows"].where("d IS NOT NULL")
    return model.score_slate(b, rows, "rid", "venue_id", ["away_pitcher"], ("away_n", "home_n"), consensus(t), ["matchup"], C("rid") % 2 == 0, _scratch(t, "n03"), "rule", NOW, replace(DAY, min_coverage=0.3))


@query("n06_monitoring", f"SELECT 'summary' AS kind, count(*) AS n, round(avg({BRIER}), 6) AS value FROM grades UNION ALL SELECT 'alerts', count(*), NULL FROM (SELECT floor(p * 10) FROM {TAIL} g WHERE p < 1 AND (SELECT count(*) FROM {TAIL} z) >= 100 GROUP BY 1 HAVING count(*) >= 20 AND abs(avg(p) - avg(CAST(y AS DOUBLE))) > 0.07) a")
def _(t):
    s = metrics.summary(t.grades, "p", "y").select(F.lit("summary").alias("kind"), "n", r("brier").alias("value"))
    a = metrics.drift_alerts(t.grades, "p", "y", "graded_at", ["event_id"]).agg(F.count(F.lit(1)).alias("n"))
    return s.unionByName(a.select(F.lit("alerts").alias("kind"), "n", F.lit(None).cast("double").alias("value")))
