"""Market consensus over the latest quotes of several books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.exprs import finite, market_reason, probability
from tidemark.operators.ranges import RANGE_ROWS, with_medians


def age_seconds(at: Column, now: Column) -> Column:
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))


def quote_valid(p: Column, price: Column) -> Column:
    return probability(p) & finite(price) & (price != 0)


def consensus(quotes: DataFrame, keys: Sequence[str], p: str, price: str, at: str, now: Column, config: EngineConfig = DEFAULT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per key: ``p_market`` (median), ``best_price`` (largest), ``books_n``, ``age_s``.

    Fresh valid quotes count; below the number of books the values are null. The age is the largest
    of the quotes that count, or where none does the smallest of those not in the future, so that
    the reason can say how stale the market is.
    """
    age = age_seconds(F.col(at), now)
    fresh = F.coalesce(age.between(0, config.max_quote_age_seconds) & quote_valid(F.col(p), F.col(price)), F.lit(False))
    rows = quotes.select(*keys, F.when(fresh, F.col(p)).alias("_of"), F.col(price).alias("_price"), age.alias("_age"), fresh.alias("_fresh"))
    out = with_medians(rows, keys, [
        F.max(F.when(F.col("_fresh"), F.col("_price"))).alias("_price"),
        F.count_if("_fresh").alias("books_n"),
        F.coalesce(F.max(F.when(F.col("_fresh"), F.col("_age"))), F.min(F.when(F.col("_age") >= 0, F.col("_age")))).alias("age_s"),
    ], {"_p": "_of"}, range_rows)
    enough = F.col("books_n") >= config.min_books
    return out.select(*keys, F.when(enough, F.col("_p")).alias("p_market"), F.when(enough, F.col("_price")).alias("best_price"), "books_n", "age_s")


def closing_price(quotes: DataFrame, keys: Sequence[str], p: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact median per key over latest quotes."""
    return with_medians(quotes.select(*keys, F.col(p).alias("_p")), keys, [], {"p_close": "_p"}, range_rows)


def with_market(games: DataFrame, market: DataFrame, keys: Sequence[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """Every game, with its market where there is one and ``market_reason`` where it cannot be used."""
    joined = games.join(market, list(keys), "left")
    return joined.withColumn("market_reason", market_reason(F.col("p_market"), F.col("books_n"), F.col("age_s"), config))


def books_map(quotes: DataFrame, keys: Sequence[str], book: str, fields: Sequence[str], at: str) -> DataFrame:
    """Newest capture per key, and a map of its books."""
    entry = F.struct(F.col(book), F.struct(*fields))
    return quotes.groupBy(*keys).agg(F.max(at).alias("newest"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("books"))
