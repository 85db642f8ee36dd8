"""The feature catalogue of a two-sided contest: formulas over as-of frames of named histories.

Every side has entity, team and lineup families; venue, weather and calendar are shared. Missing
stays null; a family whose entity is unknown does not apply and leaves the coverage denominator, and
so does the weather of an indoor event, whose values are kept.

For each kind of key (entity, team, lineup member) the two sides of a request are narrow rows of their own, which pass
through one shuffle by that key and meet as neighbours by request, where the request's own columns join them.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import indicator, iso_week, season, weather_missing, wind_out
from tidemark.operators.asof import HOT_ROWS, History, LastRows, asof_many, family_missing, few_keys, observed, per_observation, ratio, top_members_means
from tidemark.sources.scratch import at_once

# Frames in days, and the rows of the last-N frame.
ENTITY_DAYS, TEAM_DAYS, FORM_DAYS, LAST_STARTS = (7, 14, 30, 90, 365), (7, 14, 30, 365), 30, 30
#: Values of a team's games that a feature is made of, by the end of its name.
TEAM_VALUES = {"rpg": ["runs"], "avg": ["hits", "at_bats"], "slg": ["total_bases", "at_bats"], "obp": ["times_on_base", "plate_appearances"], "woba": ["woba_num", "woba_den"]}


@dataclass(frozen=True)
class Histories:
    """Histories by the columns of ``specs.SPECS``; only first innings of the inning logs are used. ``of_pitchers``, if given, derives
    them from rows of the pitchers in a table of keys alone: Spark pushes no such choice below a sum whose result is filtered too."""

    pitcher_games: DataFrame
    pitcher_innings: DataFrame
    statcast_daily: DataFrame
    team_games: DataFrame
    team_innings: DataFrame
    batter_games: DataFrame
    venue_factors: DataFrame
    of_pitchers: Callable[[DataFrame], Histories] | None = None


def entity_columns() -> dict[str, Column]:
    """The entity family over the frames of ``games``, ``first`` and ``form`` and the last-N frame."""
    c = F.col
    era = lambda w: ratio(c(f"g_{w}_earned_runs"), c(f"g_{w}_innings_pitched"), 9.0)
    whip = lambda w: ratio(c(f"g_{w}_hits") + c(f"g_{w}_walks"), c(f"g_{w}_innings_pitched"))
    out: dict[str, Column] = {
        "p_career_era": era("all"), "p_career_k9": ratio(c("g_all_strikeouts"), c("g_all_innings_pitched"), 9.0),
        "p_career_bb9": ratio(c("g_all_walks"), c("g_all_innings_pitched"), 9.0), "p_career_whip": whip("all"),
        "p_career_ip": c("g_all_innings_pitched"), "p_rest_days": F.datediff("d", "prev_day").cast("double"),
    }
    for n in ENTITY_DAYS:
        out |= {f"p_{n}d_era": era(f"{n}d"), f"p_{n}d_whip": whip(f"{n}d"), f"p_{n}d_starts": c(f"g_{n}d_rows").cast("double")}
    runs, n, f = c("f_all_first_inning_runs"), c("f_all_first_inning_runs_n"), "f_all_first_inning_"
    both = F.when((c(f + "hits_n") > 0) & (c(f + "walks_n") > 0), F.least(f + "hits_n", f + "walks_n"))
    w = f"s_{FORM_DAYS}d_"
    return out | {
        "p_30gs_era": ratio(c("last_earned_runs"), c("last_innings_pitched"), 9.0),
        "p_30gs_k9": ratio(c("last_strikeouts"), c("last_innings_pitched"), 9.0),
        "p_fi_ra9": per_observation(runs, n) * 9.0, "p_fi_runs_rate": per_observation(runs, n),
        "p_fi_whip": (c(f + "hits") + c(f + "walks")) / both,
        "p_fi_zero_rate": per_observation(c("f_all_zero"), c("f_all_zero_n")), "p_fi_games": n.cast("double"),
        "p_avg_exit_velo": ratio(c(w + "exit_velocity_sum"), c(w + "batted_balls")),
        "p_barrel_pct": ratio(c(w + "barrels"), c(w + "batted_balls"), 100.0),
        "p_hard_hit_pct": ratio(c(w + "hard_hits"), c(w + "batted_balls"), 100.0),
        "p_whiff_pct": ratio(c(w + "whiffs"), c(w + "swings"), 100.0),
    }


def team_columns() -> dict[str, Column]:
    c = F.col
    out = {
        "t_season_avg": ratio(c("g_365d_hits"), c("g_365d_at_bats")), "t_season_obp": ratio(c("g_365d_times_on_base"), c("g_365d_plate_appearances")),
        "t_season_slg": ratio(c("g_365d_total_bases"), c("g_365d_at_bats")), "t_season_woba": ratio(c("g_365d_woba_num"), c("g_365d_woba_den")),
        "t_season_rpg": per_observation(c("g_365d_runs"), c("g_365d_runs_n")),
        "t_fi_rpg": per_observation(c("f_365d_first_inning_runs"), c("f_365d_first_inning_runs_n")),
        "t_fi_scoring_pct": per_observation(c("f_365d_any_run"), c("f_365d_any_run_n")),
    }
    for n in TEAM_DAYS[:-1]:
        out |= {f"t_{n}d_rpg": per_observation(c(f"g_{n}d_runs"), c(f"g_{n}d_runs_n")), f"t_{n}d_woba": ratio(c(f"g_{n}d_woba_num"), c(f"g_{n}d_woba_den"))}
    return out


def _slim(sides: DataFrame, keys: DataFrame | None, histories: Sequence[History | LastRows]) -> list[History | LastRows]:
    """``histories`` of the ``keys`` that ``sides`` ask for, where these are few, with the totals that their values need. The passes that
    tell run beside each other."""
    if keys is not None:
        histories = [x.asked(keys) for x in histories]
    return at_once(sides.sparkSession, lambda x: x.surveyed() if isinstance(x, History) else x, histories)


def _asks(wanted: Collection[str]) -> Callable[..., bool]:
    """Whether any of the wanted columns begins with one of the given texts."""
    return lambda *begins: any(c.startswith(begins) for c in wanted)


def entity_family(h: Histories, sides: DataFrame, hot_rows: int = HOT_ROWS, wanted: Collection[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``rid, role`` of ``sides`` (rows ``rid, role, d, entity``) with the columns of the entity family, or the ``wanted`` ones by the
    histories and frames that these need, and their names."""
    columns = {n: c for n, c in entity_columns().items() if wanted is None or n in wanted}
    asks, histories, keys = _asks(columns), [], few_keys(sides, "entity")
    if keys is not None and h.of_pitchers:
        h = h.of_pitchers(keys)
    days, career = [n for n in ENTITY_DAYS if asks(f"p_{n}d_")], asks("p_career_", "p_rest_")
    if days or career:
        histories.append(History(h.pitcher_games, "pitcher_id", "game_date", ["earned_runs", "strikeouts", "walks", "hits", "innings_pitched"], days, career, "g_"))
    if asks("p_fi_"):
        first = h.pitcher_innings.where("inning = 1").withColumn("zero", indicator(F.col("first_inning_runs"), F.col("first_inning_runs") == 0))
        histories.append(History(first, "pitcher_id", "game_date", ["first_inning_runs", "first_inning_hits", "first_inning_walks", "zero"], (), True, "f_"))
    if asks("p_avg_", "p_barrel_", "p_hard_", "p_whiff_"):
        histories.append(History(h.statcast_daily, "pitcher_id", "game_date", ["exit_velocity_sum", "barrels", "hard_hits", "whiffs", "swings", "batted_balls"], (FORM_DAYS,), False, "s_"))
    if asks(f"p_{LAST_STARTS}gs_"):
        histories.append(LastRows(h.pitcher_games, "pitcher_id", "game_date", "game_id", ["earned_runs", "strikeouts", "innings_pitched"], LAST_STARTS))
    rows = asof_many(sides, "entity", "d", _slim(sides, keys, histories), hot_rows)
    return rows.select("rid", "role", *[c.alias(n) for n, c in columns.items()]), list(columns)


def team_family(h: Histories, sides: DataFrame, hot_rows: int = HOT_ROWS, wanted: Collection[str] | None = None) -> tuple[DataFrame, list[str]]:
    """As ``entity_family``, for rows ``rid, role, d, team``."""
    columns = {n: c for n, c in team_columns().items() if wanted is None or n in wanted}
    asks, histories = _asks(columns), []
    days = [n for n in TEAM_DAYS if asks("t_season_" if n == TEAM_DAYS[-1] else f"t_{n}d_")]
    if days:
        values = list(dict.fromkeys(v for c in columns if not c.startswith("t_fi_") for v in TEAM_VALUES[c.rpartition("_")[2]]))
        histories.append(History(h.team_games, "team", "game_date", values, days, False, "g_"))
    if asks("t_fi_"):
        scored = h.team_innings.where("inning = 1").withColumn("any_run", indicator(F.col("first_inning_runs"), F.col("first_inning_runs") > 0))
        histories.append(History(scored, "team", "game_date", ["first_inning_runs", "any_run"], (365,), False, "f_"))
    rows = asof_many(sides, "team", "d", _slim(sides, few_keys(sides, "team"), histories), hot_rows)
    return rows.select("rid", "role", *[c.alias(n) for n, c in columns.items()]), list(columns)


def paired(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """``_rid`` and the columns ``away_v``, ``home_v`` of the two rows of each request, which meet as neighbours."""
    sides = rows.select(F.col("rid").alias("_rid"), "role", F.struct(*values).alias("away"))
    sides = sides.withColumn("home", F.lead("away").over(Window.partitionBy("_rid").orderBy("role"))).where("role = 'away'")
    return sides.select("_rid", *[F.col(f"{r}.{v}").alias(f"{r}_{v}") for r in ("away", "home") for v in values])


def build(h: Histories, requests: DataFrame, hot_rows: int = HOT_ROWS, wanted: Sequence[str] | None = None) -> DataFrame:
    """One row per request (``rid, d, away_pitcher, home_pitcher, away_team, home_team, venue_id, away_lineup,
    home_lineup, is_dome, temp_f, wind_speed, wind_dir, azimuth, humidity, is_doubleheader``) with all
    feature columns, ``coverage`` and ``missing_count``. ``rid`` names a request and is not repeated. ``requests`` is read several
    times: give a table, not a long derivation.

    With ``wanted``, names of features: the request's columns and these, by the histories and frames that they need. Coverage
    is of all features and is left out."""
    roles = ("away", "home")
    bare = None if wanted is None else {c.partition("_")[2] for c in wanted if c.startswith(roles)}
    side = lambda r, c, name: requests.select("rid", "d", F.lit(r).alias("role"), F.col(f"{r}_{c}").alias(name))
    sides = lambda c, name: side("away", c, name).unionByName(side("home", c, name))
    names = {"lineup_top3_woba": ("woba_num", "woba_den"), "lineup_top3_obp": ("times_on_base", "plate_appearances")}
    asks = lambda columns: bare is None or any(c in bare for c in columns)
    entity, team, families_of = list(entity_columns()), list(team_columns()), []
    if asks(entity):
        families_of.append(lambda: entity_family(h, sides("pitcher", "entity"), hot_rows, bare))
    if asks(team):
        families_of.append(lambda: team_family(h, sides("team", "team"), hot_rows, bare))
    if asks(names):
        families_of.append(lambda: (top_members_means(h.batter_games, sides("lineup", "members"), ["rid", "role"], "members", "d", "batter_id", "game_date", names, FORM_DAYS, hot_rows=hot_rows), list(names)))
    found = at_once(requests.sparkSession, lambda family: family(), families_of)  # each counts keys and surveys histories first
    kept = [c for c in requests.columns if not c.endswith("_lineup")]
    # families meet their request by its id: everything is dealt by it once
    out = requests.select(*kept)
    for i, (rows, values) in enumerate(found):
        out = out.join(paired(rows, values).withColumnRenamed("_rid", f"_rid{i}"), F.col("rid") == F.col(f"_rid{i}"), "left").drop(f"_rid{i}")
    factors = h.venue_factors.select(F.col("venue_id").alias("_venue"), *[F.col(f"{x}_factor").alias(f"park_{x}_factor") for x in ("runs", "hr", "hits")])
    out = out.join(factors, F.col("venue_id") == F.col("_venue"), "left").drop("_venue")
    park = ["park_runs_factor", "park_hr_factor", "park_hits_factor"]
    dome = F.coalesce("is_dome", F.lit(False))
    shared = {
        "park_missing": family_missing(park), "wind_out_component": wind_out(F.col("wind_speed"), F.col("wind_dir"), F.col("azimuth")),
        "weather_missing": weather_missing(F.col("is_dome"), F.col("temp_f"), F.col("wind_speed")), "season": season(F.col("d")).cast("double"),
        "season_week": iso_week(F.col("d")).cast("double"), "is_doubleheader": F.coalesce("is_doubleheader", F.lit(False)).cast("double"),
        "is_dome": dome.cast("double"),
    }
    if wanted is not None:
        return out.withColumns(shared).select(*dict.fromkeys([*kept, *wanted]))
    families: list[tuple[list[str], Column]] = []
    flags: dict[str, Column] = {}
    for columns, source in ((entity, "pitcher"), (team, "team")):
        for r in roles:
            cols = [f"{r}_{n}" for n in columns]
            flags[f"{r}_{columns[0][0]}_missing"] = family_missing(cols)
            families.append((cols, F.col(f"{r}_{source}").isNotNull() & (F.col(f"{r}_{source}").cast("string") != "")))
    for r in roles:
        cols = [f"{r}_{n}" for n in names]
        flags[f"{r}_lineup_missing"] = family_missing(cols)
        families.append((cols, F.lit(True)))
    weather = ["temp_f", "wind_speed", "humidity", "wind_out_component"]
    out = out.withColumns(flags | shared)
    families += [(park, F.lit(True)), (weather, F.col("is_dome") == 0.0), (["season", "season_week", "is_doubleheader", "is_dome"], F.lit(True))]
    count = [c for cols, _ in families for c in cols]
    applicable = sum((F.when(on, len(cols)).otherwise(0) for cols, on in families), F.lit(0))
    seen = sum((F.when(on, observed(cols)).otherwise(0) for cols, on in families), F.lit(0))
    return out.withColumns({"coverage": seen / applicable, "missing_count": applicable - seen, "n_features": F.lit(len(count))})
