"""As-of features: what was known of an entity strictly before a date.

History is summed to (key, day) first, which makes ties within a day harmless and leaves a key at most one row a
day, and from these to running totals. Requests join the totals as marked rows that carry their own columns (``_before``), in
one shuffle and one sort for several histories, and each frame looks up the total at its end and at its start: a frame is the
difference of the two, whatever its length.

Running totals are exact. A value is split into parts on fixed grids (``GRIDS``), whose sums as doubles lose no bit up
to 2**97; only what is below the finest grid is summed with rounding, by less than 2**-70 a row. So a huge value
long before a frame leaves no trace in it. NaN counts as missing. Infinite values are counted, and a frame that holds any is
infinite, or NaN if it holds both.

``last_n`` keeps, instead of totals, the sums over the last rows up to each day, which are summed afresh for each day.

A sum over a window with rows counts missing values as 0; a window without rows gives null, and so do
counts of nothing. Requests with a null key or day get nulls; they are dealt over many tasks, and so are
requests of a key that has more than ``HOT_ROWS`` of them: each of those tasks gets the key's history, a row a
day. Columns of the requests may have any names but those that the result adds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stage

#: Tasks over which requests without a key or day are dealt.
KEYLESS = 1024
#: Requests of one key for one task. Keys with more are at most the number of requests divided by this: they are broadcast.
HOT_ROWS = 1_000_000
#: Keys that are few enough to be broadcast, to leave out the history of all others.
FEW_KEYS = 100_000
#: Parts of a value are multiples of these.
GRIDS = (2.0**44, 2.0**12, 2.0**-20)


def day_number(day: Column) -> Column:
    return F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date"))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """Scaled ratio of sums; null for a zero or null denominator."""
    return F.lit(scale) * numerator / F.nullif(denominator, F.lit(0.0))


def per_observation(total: Column, observed: Column) -> Column:
    """Mean over observed values only."""
    return total / F.nullif(observed, F.lit(0))


def observed_value(column: str) -> str:
    """SQL of a number as a double, null where it is missing or NaN."""
    return f"nanvl(CAST(`{column}` AS DOUBLE), NULL)"


@dataclass(frozen=True)
class Needs:
    """What a value's totals must hold: which parts are anything but zero in some row, and whether any is missing or infinite."""

    parts: tuple[int, ...] = tuple(range(len(GRIDS) + 1))
    missing: bool = True
    odd: bool = True


def _over(end: str) -> str:
    return f"OVER (PARTITION BY _k, _salt ORDER BY _d RANGE BETWEEN UNBOUNDED PRECEDING AND {end})"


@dataclass(frozen=True)
class History:
    """Rows of one history: its columns come out as ``{name}{frame}_{value}``. ``needs``, by value, spares totals that are zero
    throughout; ``surveyed`` finds them."""

    rows: DataFrame
    key: str
    day: str
    values: Sequence[str]
    days: Sequence[int] = ()
    career: bool = True
    name: str = ""
    needs: dict[str, Needs] | None = None

    def of(self, value: str) -> Needs:
        return (self.needs or {}).get(value, Needs())

    def frames(self) -> dict[str, int | None]:
        return {f"{n}d": n for n in self.days} | ({"all": None} if self.career else {})

    def starts(self) -> set[int]:
        return set(self.days)

    def whole(self, value: str) -> bool:
        """Small integers need no parts: their sums are exact as they are."""
        return self.rows.schema[value].dataType.typeName() in ("byte", "short", "integer")

    def totals(self) -> dict[str, str]:
        """SQL aggregates over prepared rows, by name: rows, and per value its parts, observations and infinities."""
        out = {"rows": "count(1)"}
        for i, v in enumerate(self.values):
            if self.whole(v):
                out[f"p{i}_0"] = f"coalesce(sum(CAST(`{v}` AS BIGINT)), 0L)"
                if self.of(v).missing:
                    out[f"c{i}"] = f"count(`{v}`)"
                continue
            for j in self.of(v).parts:
                out[f"p{i}_{j}"] = f"coalesce(sum(_p{i}_{j}), 0D)"
            if self.of(v).missing:
                out[f"c{i}"] = f"count(_x{i})"
            if self.of(v).odd:  # infinities of either sign in one number
                out[f"o{i}"] = f"count_if(_x{i} = double('inf')) + count_if(_x{i} = double('-inf')) * 4294967296L"
        return out

    def _split(self) -> DataFrame:
        """``_k, _d``, the values and, for each that has parts, the number itself and the parts."""
        known = self.rows.where(F.col(self.key).isNotNull() & F.col(self.day).isNotNull())
        known = known.select(F.col(self.key).alias("_k"), day_number(F.col(self.day)).alias("_d"), *[F.col(f"`{v}`") for v in self.values])
        split = [(i, v) for i, v in enumerate(self.values) if not self.whole(v)]
        known = known.selectExpr("*", *[f"{observed_value(v)} AS _x{i}" for i, v in split])
        known = known.selectExpr("*", *[f"IF(abs(_x{i}) < double('inf'), _x{i}, NULL) AS _rest{i}_0" for i, _ in split])
        for j, grid in enumerate(GRIDS):  # a part that is zero throughout takes nothing from the rest
            held = [i for i, v in split if j in self.of(v).parts]
            known = known.selectExpr("*", *[f"rint(_rest{i}_{j} / {grid!r}D) * {grid!r}D AS _p{i}_{j}" for i in held])
            known = known.selectExpr("*", *[f"_rest{i}_{j} - _p{i}_{j} AS _rest{i}_{j + 1}" if i in held else f"_rest{i}_{j} AS _rest{i}_{j + 1}" for i, _ in split])
        return known.withColumnsRenamed({f"_rest{i}_{len(GRIDS)}": f"_p{i}_{len(GRIDS)}" for i, _ in split})

    def daily(self) -> DataFrame:
        """Totals per key and day."""
        return self._split().groupBy("_k", "_d").agg(*[F.expr(e).alias(n) for n, e in self.totals().items()])

    def surveyed(self) -> History:
        """This history with its ``needs``, found in one pass over its rows: a job that returns one row."""
        known, facts = replace(self, needs=None)._split(), []
        for i, v in enumerate(self.values):
            seen = f"`{v}`" if self.whole(v) else f"_x{i}"
            facts.append(f"count_if({seen} IS NULL) > 0 AS m{i}")
            if not self.whole(v):
                facts.append(f"count_if(abs(_x{i}) = double('inf')) > 0 AS o{i}")
                facts += [f"count_if(_p{i}_{j} <> 0) > 0 AS p{i}_{j}" for j in range(len(GRIDS) + 1)]
        got = known.selectExpr(*facts).first()
        parts = lambda i: tuple(j for j in range(len(GRIDS) + 1) if got[f"p{i}_{j}"]) or (len(GRIDS),)
        return replace(self, needs={v: Needs((0,), got[f"m{i}"], False) if self.whole(v) else Needs(parts(i), got[f"m{i}"], got[f"o{i}"]) for i, v in enumerate(self.values)})

    def asked(self, keys: DataFrame) -> History:
        """This history without keys that ``keys``, a table of few rows, lacks."""
        return replace(self, rows=asked_for(self.rows, self.key, keys))

    def zero(self) -> str:
        """SQL of the state before the first row."""
        zeros = {n: "0D" if n.startswith("p") and not self.whole(self.values[int(n[1:].partition("_")[0])]) else "0L" for n in self.totals()}
        return "named_struct('day', 0, " + ", ".join(f"'{n}', {z}" for n, z in zeros.items()) + ")"

    def states(self) -> DataFrame:
        """``_k, _d`` and, packed, what a lookup finds from that day on: the totals up to it, and the day."""
        upto = "OVER (PARTITION BY _k ORDER BY _d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        running = self.daily().selectExpr("_k", "_d", *[f"sum({n}) {upto} AS {n}" for n in self.totals()])
        return running.select("_k", "_d", F.struct(F.col("_d").alias("day"), *self.totals()).alias(f"_of_{self.name}"))

    def outputs(self) -> list[str]:
        """SQL of the columns of all frames, from the states found at ends (null where there is none) and at starts (``zero``)."""
        out, end = [], f"_at_{self.name}_0"
        for w, n in self.frames().items():
            start = n and f"_at_{self.name}_{n}"
            since = lambda field: f"{end}.{field}" if start is None else f"({end}.{field} - {start}.{field})"  # noqa: E731, B023
            n_rows = since("rows")
            out.append(f"nullif({n_rows}, 0) AS `{self.name}{w}_rows`")
            for i, v in enumerate(self.values):
                if self.whole(v):
                    total = f"CAST({since(f'p{i}_0')} AS DOUBLE)"
                else:
                    total = " + ".join(since(f"p{i}_{j}") for j in self.of(v).parts)
                    if self.of(v).odd:
                        odd = since(f"o{i}")
                        beyond = f"IF({odd} % 4294967296 = 0, double('-inf'), IF({odd} < 4294967296, double('inf'), double('nan')))"
                        total = f"IF({odd} = 0, {total}, {beyond})"
                out.append(f"IF({n_rows} > 0, {total}, NULL) AS `{self.name}{w}_{v}`")
                out.append(f"nullif({since(f'c{i}') if self.of(v).missing else n_rows}, 0) AS `{self.name}{w}_{v}_n`")
        return out


@dataclass(frozen=True)
class LastRows:
    """The last ``n`` rows of one history, in the order (day, ``tie``): columns ``{name}_{value}``, ``_n`` and ``{name}_rows``."""

    rows: DataFrame
    key: str
    day: str
    tie: str
    values: Sequence[str]
    n: int
    name: str = "last"

    def starts(self) -> set[int]:
        return set()

    def asked(self, keys: DataFrame) -> LastRows:
        return replace(self, rows=asked_for(self.rows, self.key, keys))

    def states(self) -> DataFrame:
        """``_k, _d`` and, packed, sums over the last rows up to the end of that day.

        Of a day only its last ``n`` rows can count. That limit is taken per (key, day) before and after a shuffle, so a key
        or day that has a third of all rows comes to ``n`` rows a day.
        """
        known = self.rows.where(F.col(self.key).isNotNull() & F.col(self.day).isNotNull())
        known = known.select(F.col(self.key).alias("_k"), day_number(F.col(self.day)).alias("_d"), F.col(f"`{self.tie}`").alias("_t"), *[F.expr(observed_value(v)).alias(f"_x{i}") for i, v in enumerate(self.values)])
        back = Window.partitionBy("_k", "_d").orderBy(F.desc_nulls_last("_t"))
        known = known.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= self.n)
        frame = f"OVER (PARTITION BY _k ORDER BY _d, _back DESC ROWS BETWEEN {self.n - 1} PRECEDING AND CURRENT ROW)"
        sums = [f"coalesce(sum(_x{i}) {frame}, 0D) AS s{i}" for i in range(len(self.values))]
        counts = [f"count(_x{i}) {frame} AS c{i}" for i in range(len(self.values))]
        last = known.selectExpr("_k", "_d", "_back", f"CAST(count(1) {frame} AS INT) AS rows", *sums, *counts).where("_back = 1")
        return last.select("_k", "_d", F.struct("rows", *[f"{c}{i}" for i in range(len(self.values)) for c in "sc"]).alias(f"_of_{self.name}"))

    def outputs(self) -> list[str]:
        at = f"_at_{self.name}_0"
        values = [(f"{at}.s{i} AS `{self.name}_{v}`", f"nullif({at}.c{i}, 0) AS `{self.name}_{v}_n`") for i, v in enumerate(self.values)]
        return [f"{at}.rows AS `{self.name}_rows`", *[e for pair in values for e in pair]]


def few_keys(requests: DataFrame, key: str, most: int = FEW_KEYS) -> DataFrame | None:
    """The keys of ``requests``, where they are ``most`` at most. Counts them: give a table, not a long derivation."""
    keys = requests.select(F.col(key).alias("_wanted")).where("_wanted IS NOT NULL").distinct()
    return stage(keys, "keys") if keys.limit(most + 1).count() <= most else None


def asked_for(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` of the keys that ``keys`` holds."""
    if rows.schema[key].dataType != keys.schema["_wanted"].dataType:  # they would meet as another type
        return rows
    return rows.join(F.broadcast(keys), F.col(f"`{key}`") == F.col("_wanted"), "left_semi")


def _marked(requests: DataFrame, key: str, day: str) -> DataFrame:
    """Requests as rows ``_k, _d, _asked``: the last holds the request itself."""
    return requests.select(F.col(key).alias("_k"), day_number(F.col(day)).alias("_d"), F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("_asked"))


def _dealt(asked: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``asked`` with ``_salt``, and the keys whose rows have several salts."""
    lacks = F.col("_k").isNull() | F.col("_d").isNull()
    spread = F.xxhash64(F.to_json("_asked"))
    keyless = F.when(lacks, F.pmod(spread, F.lit(KEYLESS)))
    if not hot_rows:
        return asked.withColumn("_salt", F.coalesce(keyless, F.lit(0)).cast("int")), None
    counts = asked.where(~lacks).groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = counts.select("_k", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    asked = asked.join(F.broadcast(hot), "_k", "left")
    return asked.withColumn("_salt", F.coalesce(keyless, F.pmod(spread, F.col("_salts")), F.lit(0)).cast("int")).drop("_salts"), hot


def _before(requests: DataFrame, key: str, day: str, histories: Sequence[History | LastRows], hot_rows: int) -> DataFrame:
    """``_asked`` and, per history, its state at the day before (``_at_name_0``) and before each frame (``_at_name_n``)."""
    asked, hot = _dealt(_marked(requests, key, day), hot_rows)
    rows = asked
    for h in histories:
        states = h.states()
        if hot is None:
            states = states.withColumn("_salt", F.lit(0))
        else:
            states = states.join(F.broadcast(hot), "_k", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        rows = rows.unionByName(states, allowMissingColumns=True)
    found = [f"last(`_of_{h.name}`, true) {_over(f'{n + 1} PRECEDING')} AS `_at_{h.name}_{n}`" for h in histories for n in sorted({0, *h.starts()})]
    return _from_zero(rows.selectExpr("_asked", *found).where("_asked IS NOT NULL"), histories)


def _from_zero(found: DataFrame, histories: Sequence[History | LastRows]) -> DataFrame:
    """``found`` with the state before the first row at starts that lie before a history."""
    starts = {f"_at_{h.name}_{n}": F.expr(f"coalesce(`_at_{h.name}_{n}`, {h.zero()})") for h in histories for n in h.starts()}
    return found.withColumns(starts) if starts else found


def asof_many(requests: DataFrame, key: str, day: str, histories: Sequence[History | LastRows], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``requests`` with the frames of several histories of one kind of key, in one shuffle: per history and
    frame ``w`` the columns ``w_v`` (sum), ``w_v_n`` (observed count) and ``w_rows`` (row count), each behind the
    history's name, and ``prev_day``, the last earlier day of the first history. ``hot_rows`` = 0 deals no key over several
    tasks and counts none."""
    found = _before(requests, key, day, histories, hot_rows)
    prev = [f"date_add(DATE'1970-01-01', `_at_{histories[0].name}_0`.day) AS prev_day"] if isinstance(histories[0], History) else []
    return found.selectExpr("_asked.*", *[e for h in histories for e in h.outputs()], *prev)


def asof(
    history: DataFrame,
    requests: DataFrame,
    key: str,
    day: str,
    values: Sequence[str],
    days: Sequence[int] = (),
    career: bool = True,
    request_key: str | None = None,
    request_day: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``requests`` with, for each frame ``w`` (``7d``, ``all``) and value ``v``, the columns ``w_v`` (sum),
    ``w_v_n`` (observed count), ``w_rows`` (row count), and ``prev_day``, the last earlier day."""
    return asof_many(requests, request_key or key, request_day or day, [History(history, key, day, values, days, career)], hot_rows)


def last_n(
    history: DataFrame, requests: DataFrame, key: str, day: str, tie: str, values: Sequence[str], n: int,
    request_key: str | None = None, request_day: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``requests`` with ``last_v`` and ``last_v_n`` over the last ``n`` rows before the request's day,
    rows being ordered by (day, ``tie``), and ``last_rows``."""
    return asof_many(requests, request_key or key, request_day or day, [LastRows(history, key, day, tie, values, n)], hot_rows)


def two_sided(requests: DataFrame, id_col: str, roles: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per request and role: ``id_col, role, entity`` and the columns to keep."""
    return requests.unpivot([id_col, *keep], [c for c in roles.values()], "_column", "entity").withColumn(
        "role", reduce(lambda out, r: out.when(F.col("_column") == roles[r], r), roles, F)
    ).drop("_column")


def by_role(features: DataFrame, id_col: str, roles: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per request: ``role_value`` for each role and value."""
    return features.groupBy(id_col).agg(*[F.expr(role_value(r, v)) for r in roles for v in values])


def role_value(role: str, value: str) -> str:
    return f"max(IF(role = '{role}', `{value}`, NULL)) AS `{role}_{value}`"


def top_members_mean(
    history: DataFrame, lineups: DataFrame, id_col: str, members: str, day: str, key: str, history_day: str,
    numerator: str, denominator: str, days: int, first: int = 3,
) -> DataFrame:
    """Mean as-of ratio of the first members of each array; null unless all of them have one."""
    return top_members_means(history, lineups, [id_col], members, day, key, history_day, {"top_mean": (numerator, denominator)}, days, first)


def top_members_means(
    history: DataFrame, lineups: DataFrame, ids: Sequence[str], members: str, day: str, key: str, history_day: str,
    ratios: dict[str, tuple[str, str]], days: int, first: int = 3, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``ids`` and the mean of each as-of ratio over the first members of each array; all of them are
    null unless every one of those members has every ratio."""
    one = lineups.select(*ids, F.col(day).alias("_day"), F.explode_outer(F.slice(F.col(members), 1, first)).alias("_member"))
    values = list(dict.fromkeys(v for pair in ratios.values() for v in pair))
    known = asof_many(one, "_member", "_day", [History(history, key, history_day, values, [days], False).surveyed()], hot_rows)
    each = {name: ratio(F.col(f"{days}d_{a}"), F.col(f"{days}d_{b}")) for name, (a, b) in ratios.items()}
    whole = reduce(lambda x, y: x & y, [F.count(c) == first for c in each.values()])
    if len(ids) > 1:  # what comes next meets by the first id: one shuffle serves both
        known = known.select(*ids, *[F.col(f"{days}d_{v}") for v in values]).repartition(ids[0])
    return known.groupBy(*ids).agg(*[F.when(whole, F.avg(c)).alias(name) for name, c in each.items()])


def observed(columns: Sequence[str]) -> Column:
    """How many of the columns are not null."""
    return F.expr(" + ".join(f"CAST(`{c}` IS NOT NULL AS INT)" for c in columns))


def coverage(columns: Sequence[str], applicable: Column | None = None) -> Column:
    """Share of observed columns among those that apply."""
    return observed(columns) / F.nullif(applicable if applicable is not None else F.lit(len(columns)), F.lit(0))


def family_missing(columns: Sequence[str]) -> Column:
    """1 where every column of a family is null."""
    return F.expr(f"IF(coalesce({', '.join(f'`{c}`' for c in columns)}) IS NULL, 1D, 0D)")


def missing_count(columns: Sequence[str]) -> Column:
    return F.lit(len(columns)) - observed(columns)
