"""Stand-in views over the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "hist": """SELECT o_custkey AS k, o_orderkey AS gid, CAST(o_orderdate AS DATE) AS d, o_totalprice AS x,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS x_null,
        o_orderstatus AS status, o_orderpriority AS priority FROM {orders}""",
    "requests": """SELECT o_orderkey AS rid, o_custkey AS k, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS d
        FROM {orders}""",
    "pitch": """SELECT l_suppkey AS pitcher, l_orderkey AS game, l_linenumber AS inning, l_returnflag AS event,
        l_linestatus AS description, l_quantity AS launch, l_extendedprice AS pre, l_extendedprice + l_linenumber AS post,
        CAST(l_shipdate AS DATE) AS d FROM {lineitem}""",
    "part_dim": "SELECT p_partkey AS venue, p_retailprice AS factor, p_name AS name, p_brand AS brand FROM {part}",
    "basket_rows": "SELECT l_orderkey AS game, l_linenumber AS ln, l_partkey AS id, l_quantity AS qty FROM {lineitem}",
    "snap": """SELECT event_id, user_id AS matchup, event_type AS book, ts AS captured_at,
        CASE WHEN value >= 100 THEN value ELSE -(100 + value) END AS price, CAST(-110 AS DOUBLE) AS under,
        CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / CAST(100 AS DOUBLE) AS p FROM {events}""",
    "pred": """SELECT event_id, user_id AS game, ts AS predicted_at, event_type AS tier,
        CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / CAST(100 AS DOUBLE) AS p FROM {events}""",
    "cust_y": """SELECT c_custkey AS game, c_nationkey AS venue,
        CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS y FROM {customer}""",
    "grades": """SELECT p.event_id, p.game, p.predicted_at AS graded_at, p.tier, p.p, c.y, c.venue,
        CASE WHEN p.event_id % 11 = 0 THEN NULL ELSE (p.p - 0.5) / 10 END AS clv
        FROM {pred} p JOIN {cust_y} c ON p.game = c.game WHERE c.y IS NOT NULL""",
}

#: The moment that stands for the present: the day after the last event.
NOW = "2024-01-31 00:00:00"


class Tables:
    """Base tables and views of one folder, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                parts = {n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
                self._known[name] = self.spark.sql(VIEWS[name], **parts)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]


def with_views(query: str) -> str:
    """DuckDB text of ``query`` with the views that it names in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(VIEWS[name])
                need.append(name)

    add(query)
    if not need:
        return query
    views = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in need)
    body = query.strip()
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
