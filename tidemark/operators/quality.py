"""Validation of loads and readiness of tables. Every row check of a load is one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.io import ContractError
from tidemark.specs import DatasetSpec


def normalise_columns(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case; names that collide are refused."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ContractError(f"column names collide: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def check_columns(columns: Sequence[str], spec: DatasetSpec) -> None:
    if missing := sorted(spec.needed - set(columns)):
        raise ContractError(f"{spec.name}: missing columns {missing}")
    if unknown := sorted(set(columns) - set(spec.columns)):
        raise ContractError(f"{spec.name}: unknown columns {unknown}")


def catalog(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name`` in lower case, its ``place`` from 0, and how many rows have a value."""
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c.lower()).alias("column_name"), F.lit(i).alias("place"), F.col(f"c{i}").alias("observed")) for i, c in enumerate(df.columns)])
    return seen.select(F.inline(rows))


def strict_date(c: Column) -> tuple[Column, Column]:
    """UTC date of a value, and whether the value is there but is no date."""
    day = F.try_to_timestamp(c.cast("string")).cast("date")
    return day, c.isNotNull() & day.isNull()


def strict_double(c: Column) -> tuple[Column, Column]:
    number = c.cast("string").try_cast("double")
    return number, c.isNotNull() & number.isNull()


def key_problems(df: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """First repeated keys with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(*keys).limit(examples)


def null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows have a null in a key."""
    some = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.agg(F.count_if(some).alias("null_key_rows"))


def validate(df: DataFrame, spec: DatasetSpec, source: str, ingested_at: Column | None = None) -> DataFrame:
    """The load's rows in the spec's types, columns in sorted order, with provenance; raises on the
    first broken rule: source, emptiness, columns, dates, numbers, null keys, repeated keys."""
    if not source or not source.strip():
        raise ContractError("source is blank")
    df = normalise_columns(df)
    check_columns(df.columns, spec)
    if df.isEmpty():
        raise ContractError(f"{spec.name}: no rows")
    good, bad = {}, {}
    for c in sorted(set(df.columns) & set(spec.columns)):
        kind = spec.columns[c]
        if kind == "date":
            good[c], bad[c] = strict_date(F.col(c))
        elif c in spec.numeric:
            number, bad[c] = strict_double(F.col(c))
            good[c] = number.cast(kind)
        else:
            good[c] = F.col(c).cast(kind)
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in spec.keys])
    found = df.agg(F.count_if(null_key).alias("_null"), *[F.count_if(b).alias(c) for c, b in bad.items()]).first().asDict()
    nulls = found.pop("_null")
    if wrong := {c: n for c, n in found.items() if n}:
        raise ContractError(f"{spec.name}: unreadable values {wrong}")
    if nulls:
        raise ContractError(f"{spec.name}: {nulls} rows with null keys")
    if repeated := key_problems(df, spec.keys).collect():
        raise ContractError(f"{spec.name}: repeated keys {[tuple(r)[:-1] for r in repeated]}")
    out = df.select(*[g.alias(c) for c, g in good.items()])
    return out.withColumns({"source": F.lit(source.strip()), "ingested_at": ingested_at if ingested_at is not None else F.current_timestamp()})


def profile(df: DataFrame, name: str, day: str | None = None) -> DataFrame:
    """One row: table, row count, first and last day."""
    date = F.col(day).cast("date") if day else F.lit(None).cast("date")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("min_date"), F.max(date).alias("max_date")).select(
        F.lit(name).alias("table_name"), "row_count", "min_date", "max_date"
    )


def contract_errors(profiles: DataFrame, contracts: DataFrame) -> DataFrame:
    """Profiles held against contracts ``table_name, required, minimum_rows, start, end, before``: one row per
    contract with an array of errors. A table without a profile is missing; null bounds are not
    checked."""
    columns = profiles if "columns" in profiles.columns else profiles.withColumn("columns", F.lit(None).cast("array<string>"))
    j = contracts.join(columns, "table_name", "left")
    absent = F.array_except("required", F.coalesce("columns", "required"))
    no_days = F.col("min_date").isNull() | F.col("max_date").isNull()
    checks = F.array(
        F.when(F.col("row_count").isNull(), F.lit("table_missing")),
        F.when(F.size(absent) > 0, F.concat(F.lit("columns_missing_"), F.array_join(F.array_sort(absent), "_"))),
        F.when(F.col("row_count") < F.col("minimum_rows"), F.concat(F.lit("row_count_"), F.col("row_count").cast("string"), F.lit("_below_"), F.col("minimum_rows").cast("string"))),
        F.when(F.col("row_count").isNotNull() & F.col("start").isNotNull() & no_days, F.lit("date_coverage_unknown")),
        F.when(F.col("min_date") > F.col("start"), F.concat(F.lit("starts_"), F.col("min_date").cast("string"), F.lit("_after_"), F.col("start").cast("string"))),
        F.when(F.col("max_date") < F.col("end"), F.concat(F.lit("ends_"), F.col("max_date").cast("string"), F.lit("_before_"), F.col("end").cast("string"))),
        F.when(F.col("max_date") >= F.col("before"), F.lit("reaches_into_holdout")),
    )
    return j.select("table_name", F.array_compact(checks).alias("errors"))


def readiness(errors: DataFrame) -> DataFrame:
    """One row: ``ready``, and every error as ``table:error`` in order."""
    flat = F.flatten(F.collect_list(F.transform("errors", lambda e: F.concat_ws(":", "table_name", e))))
    return errors.agg(F.bool_and(F.size("errors") == 0).alias("ready"), F.sort_array(flat).alias("errors"))


def require_ready(errors: DataFrame) -> None:
    report = readiness(errors).first()
    if not report["ready"]:
        raise ContractError(f"not ready: {report['errors']}")


def target_report(df: DataFrame, y: str, day: str) -> DataFrame:
    """One row on the training target: rows, classes, bad labels, first and last day."""
    known = F.col(y).isin(0, 1)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(known, F.col(y))).alias("classes"),
        F.count_if(F.col(y).isNull() | ~known).alias("bad_labels"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )


def require_target(df: DataFrame, y: str, day: str, start, end, holdout) -> None:
    """Raise on an inverted range, a range that reaches the holdout, bad labels or one class only."""
    if start > end:
        raise ContractError(f"range is inverted: {start} > {end}")
    if end >= holdout:
        raise ContractError(f"range reaches the holdout: {end} >= {holdout}")
    r = target_report(df, y, day).first()
    if r["bad_labels"] or r["classes"] < 2:
        raise ContractError(f"target: {r['bad_labels']} bad labels, {r['classes']} classes")
