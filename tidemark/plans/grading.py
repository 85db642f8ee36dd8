"""Scoring of a slate, and grading of stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.exprs import brier, closing_value, edge, effective_rows, log_loss, probability, score_status, shrink_to_group, tier
from tidemark.operators.latest import latest
from tidemark.operators.market import closing_price, with_market


def grade(predictions: DataFrame, outcomes: DataFrame, quotes: DataFrame | None, key: str, version: Sequence[str], at: str, p: str, y: str, market_keys: Sequence[str] = (), quote_p: str = "p", quote_keys: Sequence[str] = (), quote_at: str = "captured_at") -> DataFrame:
    """Latest valid prediction of each game with a known outcome, its scores, and the closing value.

    Predictions without a valid probability are skipped. A game without a closing price is graded
    with a null closing value.
    """
    last = latest(predictions, [key], at, version)
    graded = last.join(outcomes.where(F.col(y).isNotNull()), key).where(probability(F.col(p)))
    if quotes is not None:
        close = closing_price(latest(quotes, quote_keys, quote_at), market_keys, quote_p)
        graded = graded.join(close, list(market_keys), "left")
    else:
        graded = graded.withColumn("p_close", F.lit(None).cast("double"))
    out = F.col(y).cast("double")
    return graded.withColumns({"brier": brier(F.col(p), out), "log_loss": log_loss(F.col(p), out)})


def with_closing_value(graded: DataFrame, market: str, edge_col: str) -> DataFrame:
    return graded.withColumn("clv", closing_value(F.col(edge_col), F.col("p_close"), F.col(market)))


def score_slate(games: DataFrame, market: DataFrame, market_keys: Sequence[str], rates: DataFrame, rate_key: str, entities: Sequence[str], p_cal: str, n: tuple[str, str], confirmed: Column, error: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """Every game with ``p_final``, ``edge``, ``status``, ``reason`` and ``tier``. Blocked games have neither
    probability nor edge; degraded ones no edge."""
    rated = with_market(games, market, market_keys, config).join(rates.select(rate_key, "rate"), rate_key, "left")
    p = shrink_to_group(F.col(p_cal), F.col("rate"), effective_rows(F.col(n[0]), F.col(n[1]), F.col("coverage"), config), config)
    scored = rated.withColumn("p_final", p)
    scored = scored.withColumn("_s", score_status([F.col(e) for e in entities], error, F.col("coverage"), F.col("p_final"), F.col("market_reason"), config))
    scored = scored.withColumns({"status": F.col("_s.status"), "reason": F.col("_s.reason")}).drop("_s")
    fine = F.col("status") != "BLOCKED"
    return scored.withColumns({
        "p_final": F.when(fine, F.col("p_final")),
        "edge": edge(F.when(fine, F.col("p_final")), F.col("p_market"), F.col("market_reason").isNull()),
        "tier": tier(F.col("status"), confirmed, F.col("coverage"), F.coalesce("books_n", F.lit(0)), config),
    })
