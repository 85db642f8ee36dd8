"""The feature catalogue on the stand-ins: its histories and requests from orders and line items, and its SQL twin.

Suppliers pitch, customers are teams, parts bat; every order is a request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asked_for
from tidemark.operators.features import ENTITY_DAYS, FORM_DAYS, LAST_STARTS, TEAM_DAYS, Histories, build
from tidemark.plans.views import Tables
from tidemark.sources.scratch import stage

C = F.col

#: Team values are order prices modulo these.
STAND_INS = {"hits": 7, "at_bats": 11, "total_bases": 13, "times_on_base": 5, "plate_appearances": 17, "woba_num": 19, "woba_den": 23}


def histories(t: Tables, pitchers: DataFrame | None = None) -> Histories:
    """All histories; with ``pitchers``, a table of keys, those of entities hold theirs alone."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", C("l_linenumber").alias("inning"), "l_quantity", F.round(C("l_discount") * 100).alias("disc"), F.round(C("l_tax") * 100).alias("tax"), C("l_shipdate").cast("date").alias("game_date"))
    li = lines if pitchers is None else asked_for(lines, "l_suppkey", pitchers)
    pg = li.groupBy(C("l_suppkey").alias("pitcher_id"), C("l_orderkey").alias("game_id")).agg(
        F.min("game_date").alias("game_date"), F.sum("disc").alias("earned_runs"), F.sum("tax").alias("walks"), F.sum("inning").alias("hits"), F.count(F.lit(1)).alias("strikeouts"), F.sum("l_quantity").alias("innings_pitched")
    )
    pi = li.select(C("l_suppkey").alias("pitcher_id"), C("l_orderkey").alias("game_id"), "game_date", "inning", F.when(C("l_quantity") > 5, F.floor(C("l_quantity") % 3)).alias("first_inning_runs"), C("tax").alias("first_inning_hits"), C("disc").alias("first_inning_walks"))
    sc = li.groupBy(C("l_suppkey").alias("pitcher_id"), "game_date").agg(F.sum("l_quantity").alias("exit_velocity_sum"), F.sum("tax").alias("barrels"), F.sum("disc").alias("hard_hits"), F.sum("tax").alias("whiffs"), F.sum("inning").alias("swings"), F.count(F.lit(1)).alias("batted_balls"))
    o = t.orders.select(C("o_custkey").alias("team"), C("o_orderkey").alias("game_id"), C("o_orderdate").cast("date").alias("game_date"), F.round("o_totalprice").alias("v"), "o_orderstatus")
    tg = o.select("team", "game_id", "game_date", F.when(C("o_orderstatus") != "P", C("v") % 6).alias("runs"), *[(C("v") % w).alias(c) for c, w in STAND_INS.items()])
    ti = o.select("team", "game_id", "game_date", F.lit(1).alias("inning"), F.when(C("o_orderstatus") != "P", C("v") % 2).alias("first_inning_runs"))
    bg = lines.select(C("l_partkey").alias("batter_id"), C("l_orderkey").alias("game_id"), "game_date", C("tax").alias("woba_num"), C("l_quantity").alias("woba_den"), C("disc").alias("times_on_base"), C("l_quantity").alias("plate_appearances"))
    vf = t.nation.select(C("n_nationkey").alias("venue_id"), (C("n_nationkey") / 10 + 1).alias("runs_factor"), F.lit(1.0).alias("hr_factor"), F.lit(1.0).alias("hits_factor"))
    return Histories(pg, pi, sc, tg, ti, bg, vf, lambda keys: histories(t, keys))


def requests(t: Tables, lineups: bool = True) -> DataFrame:
    """One request per order: sides with and without a pitcher, weather with gaps, and, if asked for, lineups of three and fewer."""
    ids = t.lineitem.groupBy(C("l_orderkey").alias("rid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("ids"))
    order = t.orders.select(C("o_orderkey").alias("rid"), C("o_orderdate").cast("date").alias("d"), C("o_custkey").alias("away_team"))
    g, some = C("rid"), lambda on, value: F.when(on, value)
    order = order.join(ids, "rid", "left") if lineups else order
    return order.select(
        "rid", "d", (g % 97).alias("away_pitcher"), some(g % 8 == 0, g % 89).alias("home_pitcher"), "away_team", ((C("away_team") + 7) % 1500).alias("home_team"),
        (g % 30).cast("int").alias("venue_id"), *([C("ids").alias("away_lineup"), F.slice("ids", 2, 3).alias("home_lineup")] if lineups else []), (g % 3 == 0).alias("is_dome"),
        some(g % 5 != 0, 60.0 + g % 20).alias("temp_f"), some(g % 7 != 0, (g % 15).cast("double")).alias("wind_speed"), (g % 360).cast("double").alias("wind_dir"),
        some(g % 11 != 0, F.lit(45.0)).alias("azimuth"), some(g % 4 == 0, F.lit(50.0)).alias("humidity"), some(g % 6 == 0, F.lit(True)).alias("is_doubleheader"),
    )


PITCHER = ["p_career_era", "p_career_k9", "p_career_bb9", "p_career_whip", "p_career_ip", "p_rest_days", *[f"p_{n}d_{x}" for n in ENTITY_DAYS for x in ("era", "whip", "starts")],
           "p_30gs_era", "p_30gs_k9", "p_fi_ra9", "p_fi_runs_rate", "p_fi_whip", "p_fi_zero_rate", "p_fi_games", "p_avg_exit_velo", "p_barrel_pct", "p_hard_hit_pct", "p_whiff_pct"]
TEAM = ["t_season_avg", "t_season_obp", "t_season_slg", "t_season_woba", "t_season_rpg", "t_fi_rpg", "t_fi_scoring_pct", *[f"t_{n}d_{x}" for n in TEAM_DAYS[:-1] for x in ("rpg", "woba")]]
LINEUP, PARK = ["lineup_top3_woba", "lineup_top3_obp"], ["park_runs_factor", "park_hr_factor", "park_hits_factor"]
WEATHER, CALENDAR = ["temp_f", "wind_speed", "humidity", "wind_out_component"], ["season", "season_week", "is_doubleheader", "is_dome"]
SIDES = [f"{r}_{c}" for r in ("away", "home") for c in (*PITCHER, "p_missing", *TEAM, "t_missing", *LINEUP, "lineup_missing")]
FEATURES = [*SIDES, *PARK, "park_missing", *WEATHER, "weather_missing", *CALENDAR]


def features(t: Tables, wanted: Sequence[str] | None = None) -> DataFrame:
    """Every order's request columns and features, or the ``wanted`` ones. Requests are a table in use, so the derived ones are
    written first; without lineups they are columns of the orders."""
    if wanted is not None and not any("lineup" in c for c in wanted):
        return build(histories(t), requests(t, lineups=False), wanted=wanted)
    return build(histories(t), stage(requests(t), "requests"), wanted=wanted)


def catalogue(t: Tables) -> DataFrame:
    return features(t).selectExpr("rid", *[f"round({c}, 8) AS {c}" for c in FEATURES], "round(coverage, 6) AS coverage", "CAST(missing_count AS BIGINT) AS missing_count")


def _sql() -> str:
    """Range joins and filtered sums: every frame by its definition."""
    at = lambda n: "" if n is None else f" FILTER (WHERE h.gd >= p.d - {n})"
    total = lambda v, n=None: f"sum(coalesce({v}, 0)){at(n)}"
    seen = lambda v, n=None: f"nullif(count({v}){at(n)}, 0)"
    over = lambda a, b, scale=1.0: f"CAST({scale} AS DOUBLE) * ({a}) / nullif(CAST({b} AS DOUBLE), 0)"
    mean = lambda v, n=None: f"CAST({total(v, n)} AS DOUBLE) / {seen(v, n)}"
    both = lambda n=None: f"{total('hits', n)} + {total('walks', n)}"
    games = {
        "p_career_era": over(total("er"), total("ip"), 9.0), "p_career_k9": over(total("so"), total("ip"), 9.0), "p_career_bb9": over(total("walks"), total("ip"), 9.0),
        "p_career_whip": over(both(), total("ip")), "p_career_ip": total("ip"), "p_rest_days": "CAST(any_value(p.d) - max(h.gd) AS DOUBLE)",
    }
    for n in ENTITY_DAYS:
        games |= {f"p_{n}d_era": over(total("er", n), total("ip", n), 9.0), f"p_{n}d_whip": over(both(n), total("ip", n)), f"p_{n}d_starts": seen("h.gd", n)}
    last = {"p_30gs_era": over(total("er"), total("ip"), 9.0), "p_30gs_k9": over(total("so"), total("ip"), 9.0)}
    first = {
        "p_fi_ra9": f"9.0 * {mean('runs')}", "p_fi_runs_rate": mean("runs"), "p_fi_games": seen("runs"), "p_fi_zero_rate": mean("CASE WHEN runs IS NOT NULL THEN CAST(runs = 0 AS INT) END"),
        "p_fi_whip": f"CASE WHEN count(hits) > 0 AND count(walks) > 0 THEN ({both()}) / least(count(hits), count(walks)) END",
    }
    n = FORM_DAYS
    form = {"p_avg_exit_velo": over(total("velo", n), total("balls", n)), "p_barrel_pct": over(total("barrels", n), total("balls", n), 100.0),
            "p_hard_hit_pct": over(total("hard", n), total("balls", n), 100.0), "p_whiff_pct": over(total("barrels", n), total("swings", n), 100.0)}
    team = {"t_season_avg": over(total("v % 7", 365), total("v % 11", 365)), "t_season_obp": over(total("v % 5", 365), total("v % 17", 365)), "t_season_slg": over(total("v % 13", 365), total("v % 11", 365)),
            "t_season_woba": over(total("v % 19", 365), total("v % 23", 365)), "t_season_rpg": mean("runs", 365), "t_fi_rpg": mean("fi", 365), "t_fi_scoring_pct": mean("CASE WHEN fi IS NOT NULL THEN CAST(fi > 0 AS INT) END", 365)}
    for n in TEAM_DAYS[:-1]:
        team |= {f"t_{n}d_rpg": mean("runs", n), f"t_{n}d_woba": over(total("v % 19", n), total("v % 23", n))}
    columns = lambda d: ", ".join(f"{e} AS {c}" for c, e in d.items())
    part = lambda name, history, key, exprs: f"{name} AS (SELECT p.rid, p.role, {columns(exprs)} FROM sides p JOIN {history} h ON h.key = p.{key} AND h.gd < p.d GROUP BY p.rid, p.role)"
    family = lambda cols: f"CASE WHEN coalesce({', '.join(cols)}) IS NULL THEN 1.0 ELSE 0.0 END"
    ctes = [
        "li AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber AS ln, l_quantity AS q, round(l_discount * 100) AS disc, round(l_tax * 100) AS tax, CAST(l_shipdate AS DATE) AS gd FROM lineitem)",
        "ids AS (SELECT l_orderkey AS rid, list(l_partkey ORDER BY ln, l_partkey) AS ids FROM li GROUP BY 1)",
        """req AS (SELECT o.o_orderkey AS rid, CAST(o.o_orderdate AS DATE) AS d, o.o_orderkey % 97 AS away_pitcher, CASE WHEN o.o_orderkey % 8 = 0 THEN o.o_orderkey % 89 END AS home_pitcher,
          o.o_custkey AS away_team, (o.o_custkey + 7) % 1500 AS home_team, o.o_orderkey % 30 AS venue_id, i.ids FROM orders o LEFT JOIN ids i ON i.rid = o.o_orderkey)""",
        "sides AS (SELECT rid, d, 'away' AS role, away_pitcher AS pitcher, away_team AS team FROM req UNION ALL SELECT rid, d, 'home', home_pitcher, home_team FROM req)",
        "pg AS (SELECT l_suppkey AS key, l_orderkey AS game, min(gd) AS gd, sum(disc) AS er, sum(tax) AS walks, sum(ln) AS hits, count(*) AS so, sum(q) AS ip FROM li GROUP BY 1, 2)",
        "pi AS (SELECT l_suppkey AS key, gd, CASE WHEN q > 5 THEN floor(q % 3) END AS runs, tax AS hits, disc AS walks FROM li WHERE ln = 1)",
        "sc AS (SELECT l_suppkey AS key, gd, sum(q) AS velo, sum(tax) AS barrels, sum(disc) AS hard, sum(ln) AS swings, count(*) AS balls FROM li GROUP BY 1, 2)",
        """tg AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS gd, round(o_totalprice) AS v, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice) % 6 END AS runs,
          CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice) % 2 END AS fi FROM orders)""",
        part("a", "pg", "pitcher", games), part("b", "pi", "pitcher", first), part("c", "sc", "pitcher", form), part("t", "tg", "team", team),
        f"""l AS (SELECT rid, role, {columns(last)} FROM (SELECT p.rid, p.role, h.*, row_number() OVER (PARTITION BY p.rid, p.role ORDER BY h.gd DESC, h.game DESC) AS back
          FROM sides p JOIN pg h ON h.key = p.pitcher AND h.gd < p.d) x WHERE back <= {LAST_STARTS} GROUP BY rid, role)""",
        "m AS (SELECT rid, d, 'away' AS role, unnest([1, 2, 3]) AS place, unnest(ids[1:3]) AS id FROM req UNION ALL SELECT rid, d, 'home', unnest([1, 2, 3]), unnest(ids[2:4]) FROM req)",
        f"""mm AS (SELECT m.rid, m.role, m.place, {over('sum(h.tax)', 'sum(h.q)')} AS woba, {over('sum(h.disc)', 'sum(h.q)')} AS obp FROM m JOIN li h ON h.l_partkey = m.id AND h.gd < m.d AND h.gd >= m.d - {FORM_DAYS}
          GROUP BY m.rid, m.role, m.place)""",
        "u AS (SELECT rid, role, avg(woba) AS lineup_top3_woba, avg(obp) AS lineup_top3_obp FROM mm GROUP BY rid, role HAVING count(woba) = 3 AND count(obp) = 3)",
        f"""w AS (SELECT s.rid, s.role, {', '.join(PITCHER + TEAM + LINEUP)}, {family(PITCHER)} AS p_missing, {family(TEAM)} AS t_missing, {family(LINEUP)} AS lineup_missing
          FROM sides s LEFT JOIN a USING (rid, role) LEFT JOIN b USING (rid, role) LEFT JOIN c USING (rid, role) LEFT JOIN l USING (rid, role) LEFT JOIN t USING (rid, role) LEFT JOIN u USING (rid, role))""",
        """x AS (SELECT rid, d, away_pitcher, home_pitcher, n_nationkey / 10 + 1 AS park_runs_factor, n_nationkey * 0 + 1.0 AS park_hr_factor, n_nationkey * 0 + 1.0 AS park_hits_factor,
          CASE WHEN n_nationkey IS NULL THEN 1.0 ELSE 0.0 END AS park_missing, CASE WHEN rid % 3 = 0 THEN 1.0 ELSE 0.0 END AS is_dome,
          CASE WHEN rid % 5 <> 0 THEN 60.0 + rid % 20 END AS temp_f, CASE WHEN rid % 7 <> 0 THEN CAST(rid % 15 AS DOUBLE) END AS wind_speed, CASE WHEN rid % 4 = 0 THEN 50.0 END AS humidity,
          CASE WHEN rid % 7 <> 0 AND rid % 11 <> 0 THEN (rid % 15) * cos(radians((rid % 360) - 45.0)) END AS wind_out_component,
          CASE WHEN rid % 3 <> 0 AND (rid % 5 = 0 OR rid % 7 = 0) THEN 1.0 ELSE 0.0 END AS weather_missing,
          CAST(year(d) AS DOUBLE) AS season, CAST(week(d) AS DOUBLE) AS season_week, CASE WHEN rid % 6 = 0 THEN 1.0 ELSE 0.0 END AS is_doubleheader
          FROM req LEFT JOIN nation ON n_nationkey = venue_id)""",
        f"""f AS (SELECT x.*, {', '.join(f'{r}.{c} AS {r}_{c}' for r in ('away', 'home') for c in (*PITCHER, 'p_missing', *TEAM, 't_missing', *LINEUP, 'lineup_missing'))}
          FROM x JOIN w away ON away.rid = x.rid AND away.role = 'away' JOIN w home ON home.rid = x.rid AND home.role = 'home')""",
    ]
    observed = lambda cols: " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in cols)
    always = [f"{r}_{c}" for r in ("away", "home") for c in (*TEAM, *LINEUP)] + PARK + CALENDAR
    known = f"{observed(always)} + CASE WHEN is_dome = 0 THEN {observed(WEATHER)} ELSE 0 END"
    size = f"{len(always)} + CASE WHEN is_dome = 0 THEN {len(WEATHER)} ELSE 0 END"
    for r in ("away", "home"):
        known += f" + CASE WHEN {r}_pitcher IS NOT NULL THEN {observed([f'{r}_{c}' for c in PITCHER])} ELSE 0 END"
        size += f" + CASE WHEN {r}_pitcher IS NOT NULL THEN {len(PITCHER)} ELSE 0 END"
    features = ", ".join(f"round(CAST({c} AS DOUBLE), 8) AS {c}" for c in FEATURES)
    return f"WITH {', '.join(ctes)} SELECT rid, {features}, round(({known}) / ({size}), 6) AS coverage, CAST(({size}) - ({known}) AS BIGINT) AS missing_count FROM f"


CATALOGUE_SQL = _sql()
