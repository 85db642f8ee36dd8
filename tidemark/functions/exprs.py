"""Scalar operators as column expressions. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig

INFINITY = float("inf")


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INFINITY))


def probability(x: Column) -> Column:
    """True for a finite number in [0, 1]; never null."""
    return F.coalesce(finite(x) & x.between(0, 1), F.lit(False))


def american_probability(price: Column) -> Column:
    """Implied probability of an American price; null if the price is 0 or not finite."""
    up = F.lit(100.0) / (price + 100.0)
    down = F.abs(price) / (F.abs(price) + 100.0)
    return F.when(finite(price) & (price > 0), up).when(finite(price) & (price < 0), down)


def no_vig(p: Column, q: Column) -> Column:
    """Share of ``p`` in the two-way market ``p + q``; null unless both are finite and positive."""
    return F.when(finite(p) & finite(q) & (p > 0) & (q > 0), p / (p + q))


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC timestamp; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(fine), F.lit("+00:00"))


def snapshot_id(fixture: Column, book: Column, captured_at: Column) -> Column:
    """Deterministic id of one book's quote: SHA-1 of its parts joined by a pipe."""
    return F.sha1(F.concat_ws("|", fixture.cast("string"), book, iso_utc(captured_at)))


def as_utc(value: Column) -> Column:
    """Timestamp of ISO text; text without a zone is UTC, unreadable text null."""
    return F.try_to_timestamp(value)


def as_date(value: Column) -> Column:
    """Date of the first ten characters; null if they are none."""
    return F.substring(value.cast("string"), 1, 10).try_cast("date")


def as_int(value: Column) -> Column:
    return value.cast("string").try_cast("bigint")


def as_double(value: Column) -> Column:
    """Finite number, or null."""
    x = value.cast("string").try_cast("double")
    return F.when(finite(x), x)


def season(day: Column) -> Column:
    return F.year(day)


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def wind_out(speed: Column, direction: Column, azimuth: Column) -> Column:
    """Component of the wind along an axis."""
    return speed * F.cos(F.radians(direction - azimuth))


def weather_missing(is_indoor: Column, temperature: Column, wind_speed: Column) -> Column:
    """1 where an outdoor event lacks its temperature or its wind speed, else 0."""
    lacks = temperature.isNull() | F.isnan(temperature) | wind_speed.isNull() | F.isnan(wind_speed)
    return F.when(F.coalesce(is_indoor, F.lit(False)), 0.0).when(lacks, 1.0).otherwise(0.0)


def shrink_to_group(p: Column, rate: Column, n: Column, config: EngineConfig = DEFAULT) -> Column:
    """Weighted mean of a probability and its group's rate; the probability where no rate is known."""
    floor = F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(0.0))
    k = F.lit(config.shrink_strength)
    return F.coalesce((floor * p + k * rate) / (floor + k), p)


def effective_rows(a: Column, b: Column, coverage: Column, config: EngineConfig = DEFAULT) -> Column:
    """Smaller of two observed counts, capped, scaled by coverage; 0 if neither is known."""
    return F.least(F.coalesce(F.least(a, b), F.lit(0.0)), F.lit(config.shrink_cap)) * coverage


def clip(p: Column, epsilon: float = DEFAULT.clip) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2.0))


def log_loss(p: Column, y: Column, epsilon: float = DEFAULT.clip) -> Column:
    pc = clip(p, epsilon)
    return -(y * F.log(pc) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - pc))


def edge(p: Column, market: Column, usable: Column) -> Column:
    """Difference to the market where the market may be used."""
    return F.when(usable, p - market)


def closing_value(edge_: Column, close: Column, market: Column) -> Column:
    """Move of the market towards the side that the edge took; null if any input is."""
    return F.when(edge_.isNotNull(), F.when(edge_ >= 0, 1.0).otherwise(-1.0) * (close - market))


def market_reason(p: Column, books: Column, age: Column, config: EngineConfig = DEFAULT) -> Column:
    """Why a market cannot be used, first reason that holds; null if it can."""
    n, a = F.coalesce(books, F.lit(0)), age
    return (
        F.when(p.isNull(), F.lit("no_market_consensus"))
        .when(n < config.min_books, F.concat(F.lit("books_"), n.cast("string"), F.lit(f"_below_{config.min_books}")))
        .when(a.isNull(), F.lit("odds_age_unknown"))
        .when(a < 0, F.lit("odds_timestamp_in_future"))
        .when(a > config.max_quote_age_seconds, F.concat(F.lit("odds_stale_"), a.cast("long").cast("string"), F.lit("s")))
    )


def coverage_reason(coverage: Column, config: EngineConfig = DEFAULT) -> Column:
    """Block reason of a coverage below the gate, else null; a null coverage is blocked as 0."""
    c = F.coalesce(coverage, F.lit(0.0))
    return F.when(c < config.min_coverage, F.format_string(f"coverage_%.2f_below_{config.min_coverage:.2f}", c))


def tier(status: Column, confirmed: Column, coverage: Column, books: Column, config: EngineConfig = DEFAULT) -> Column:
    """LOW unless OK; HIGH if confirmed, well covered and priced by enough books; else MEDIUM."""
    high = F.coalesce(confirmed, F.lit(False)) & (coverage >= config.high_coverage) & (books >= config.min_books)
    return F.when(~status.eqNullSafe("OK"), "LOW").when(high, "HIGH").otherwise("MEDIUM")


def display_percent(p: Column) -> Column:
    """The other side's probability in percent with one decimal, half to even."""
    return F.bround((F.lit(1.0) - p) * 100.0, 1)


def display_edge(e: Column) -> Column:
    return F.bround(e * -100.0, 1)


def score_status(entities: Sequence[Column], error: Column, coverage: Column, p: Column, market: Column, config: EngineConfig = DEFAULT) -> Column:
    """``struct(status, reason)`` of a scored row, by the first reason that holds: an entity is unknown,
    features failed, coverage is low, the probability is invalid (all BLOCKED), the market cannot
    be used (DEGRADED); else OK."""
    unknown = F.lit(False)
    for e in entities:
        unknown = unknown | e.isNull()
    block = (
        F.when(unknown, F.lit("entity_unknown"))
        .when(error.isNotNull(), F.concat(F.lit("feature_error:"), error))
        .when(coverage_reason(coverage, config).isNotNull(), coverage_reason(coverage, config))
        .when(~probability(p), F.lit("invalid_probability"))
    )
    status = F.when(block.isNotNull(), "BLOCKED").when(market.isNotNull(), "DEGRADED").otherwise("OK")
    return F.struct(status.alias("status"), F.coalesce(block, market).alias("reason"))


def indicator(x: Column, hit: Column) -> Column:
    """1 or 0 for a condition on ``x``, null where ``x`` is."""
    return F.when(x.isNotNull(), hit.cast("double"))


def clean_name(name: Column, fallback: Column) -> Column:
    """Trimmed lower-case name, or the fallback's if there is none."""
    return F.lower(F.trim(F.coalesce(F.nullif(F.trim(name), F.lit("")), fallback)))


def first_matching(array: Column, condition) -> Column:
    """First element for which ``condition(element)`` holds, or null."""
    return F.try_element_at(F.filter(array, condition), F.lit(1))


def unique_or_null(array: Column) -> Column:
    """The one distinct non-null element of an array; null if there are none or several."""
    distinct = F.array_distinct(F.array_compact(array))
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def json_put(text: Column, key: str, value: Column) -> Column:
    """JSON object text with one key set at its end; other members keep their types and order. Text that
    is unreadable or no object counts as an empty object."""
    known = F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.from_json(text, "map<string,variant>"))
    known = F.map_filter(F.coalesce(known, F.create_map().cast("map<string,variant>")), lambda k, _: k != key)
    return F.to_json(F.map_concat(known, F.create_map(F.lit(key), value.cast("variant"))))
