"""Nested JSON payloads to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import american_probability, as_double, as_int, as_utc, first_matching, no_vig, snapshot_id, unique_or_null

FEED = """struct<game_id:string, status:string, away_name:string, home_name:string,
  innings:array<struct<num:int, away_runs:string, home_runs:string>>,
  players:map<string, struct<id:bigint, started:int>>>"""

ODDS = """struct<fixture_id:string, books:array<struct<name:string, updated_at:string,
  markets:array<struct<id:string, line:string, updated_at:string,
    outcomes:array<struct<side:string, price:string>>>>>>>"""

# Statuses of a finished game.
FINAL_STATUSES = ("Final", "Game Over", "Completed Early")


def outcomes_of(feeds: DataFrame, text: str, final: tuple[str, ...] = FINAL_STATUSES) -> DataFrame:
    """One row per finished game: first-inning runs of both sides, whether any scored, and the one
    starter (null if none or several started). Games whose first inning is absent, or whose runs
    are no whole number of at least 0, are left out."""
    f = feeds.select(F.from_json(text, FEED).alias("f")).select("f.*")
    first = first_matching(F.col("innings"), lambda i: i["num"] == 1)
    f = f.where(F.col("status").isin(*final)).withColumn("_i", first)
    runs = {side: as_int(F.col("_i")[f"{side}_runs"]) for side in ("away", "home")}
    started = F.filter(F.map_values("players"), lambda p: p["started"] > 0)
    f = f.withColumns({"runs_away": runs["away"], "runs_home": runs["home"], "starter": unique_or_null(F.transform(started, lambda p: p["id"]))})
    f = f.where("runs_away >= 0 AND runs_home >= 0")
    return f.select("game_id", "runs_away", "runs_home", (F.col("runs_away") + F.col("runs_home") > 0).cast("int").alias("any_run"), "starter")


def quotes_of(payloads: DataFrame, text: str, market: str, line: float = 0.5) -> DataFrame:
    """One row per book that prices the market at the line: both prices, the no-vig probability of
    the first side, the provider's time (the market's, else the book's) and the snapshot id. Rows
    without a time or a valid pair of prices are left out."""
    p = payloads.select(F.from_json(text, ODDS).alias("o")).select("o.fixture_id", F.explode("o.books").alias("b"))
    p = p.select("fixture_id", F.lower(F.trim("b.name")).alias("book"), F.col("b.updated_at").alias("_book_at"), F.explode("b.markets").alias("m"))
    p = p.where((F.col("m.id") == market) & (F.abs(as_double(F.col("m.line")) - line) <= 1e-9))

    def price(side: str) -> Column:
        return as_double(first_matching(F.col("m.outcomes"), lambda o: F.lower(o["side"]) == side)["price"])

    p = p.select("fixture_id", "book", F.coalesce(as_utc(F.col("m.updated_at")), as_utc(F.col("_book_at"))).alias("captured_at"), price("over").alias("over"), price("under").alias("under"))
    p = p.withColumn("p_novig", no_vig(american_probability(F.col("over")), american_probability(F.col("under"))))
    p = p.where("captured_at IS NOT NULL AND p_novig IS NOT NULL")
    return p.withColumn("snapshot_id", snapshot_id(F.col("fixture_id"), F.col("book"), F.col("captured_at")))
