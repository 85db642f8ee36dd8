"""Readers and writers: strict files, parameterised SQL, appends, idempotent upserts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from tidemark.sources.tables import KeyedTable


class ContractError(ValueError):
    """Input that breaks its declared contract."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; a row that does not fit the schema fails the read."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``.csv``, ``.parquet`` or ``.pq``; any other suffix is refused."""
    suffix = re.sub(r"[/*]+$", "", path).rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema) if schema is not None else spark.read.option("header", True).csv(path)
    if suffix in ("parquet", "pq"):
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    raise ContractError(f"unsupported file type: {path}")


def bulk_read(spark: SparkSession, path: str, file_format: str, schema: T.StructType | str) -> DataFrame:
    """CSV, JSON or Parquet files; one bad row fails the whole load."""
    kind = file_format.lower()
    if kind not in ("csv", "json", "parquet"):
        raise ContractError(f"unsupported format: {file_format}")
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def export(df: DataFrame, path: str) -> None:
    """Replace one Parquet dataset."""
    df.write.mode("overwrite").parquet(path)


def sql(spark: SparkSession, query: str, args: dict | list | None = None) -> DataFrame:
    """Query with positional or named parameters; column names in lower case."""
    out = spark.sql(query, args=args) if args else spark.sql(query)
    return out.toDF(*[c.lower() for c in out.columns])


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows; nothing is written for an empty input."""
    if not df.isEmpty():
        df.write.mode("append").partitionBy(*partition_by).parquet(path)


def check_keys(source: DataFrame, keys: Sequence[str]) -> None:
    """Raise unless the key columns are there, and neither null nor repeated."""
    if missing := sorted(set(keys) - set(source.columns)):
        raise ContractError(f"missing key columns: {missing}")
    nulls = source.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first().asDict()
    if bad := {k: n for k, n in nulls.items() if n}:
        raise ContractError(f"null keys: {bad}")
    repeated = source.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if repeated:
        raise ContractError(f"repeated keys: {[tuple(r)[:-1] for r in repeated]}")


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], newer: str | None = None) -> DataFrame:
    """``target`` after an upsert of ``source``: matched rows take the source's columns and keep
    the others, new rows are added. With ``newer``, a source row that is older by that column than the
    row it meets changes nothing. One full outer join on the keys."""
    values = [c for c in target.columns if c not in keys]
    mine = source.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_s_{c}") for c in values if c in source.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = target.join(mine, on, "full_outer")
    is_new = F.col(f"_k_{keys[0]}").isNotNull()
    if newer:
        is_new = is_new & ~F.coalesce(F.col(newer) > F.col(f"_s_{newer}"), F.lit(False))
    out = {k: F.coalesce(F.col(k), F.col(f"_k_{k}")) for k in keys}
    out |= {c: F.when(is_new, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in values if c in source.columns}
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in target.columns])


class Swap:
    """A Parquet dataset that is replaced whole: the new one is written aside, and two renames put it in place.

    A job that dies between the renames leaves the path empty beside the complete new dataset; the next
    one (``recover``) finishes or undoes the swap before it reads anything.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.at = lambda suffix="": jvm.org.apache.hadoop.fs.Path(self.path + suffix)
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, suffix: str = "") -> bool:
        return self.fs.exists(self.at(suffix))

    def _rename(self, source: str, to: str) -> None:
        if not self.fs.rename(self.at(source), self.at(to)):
            raise OSError(f"cannot rename {self.path}{source} to {self.path}{to}")

    def recover(self) -> None:
        if not self.exists():
            if self.exists("__new/_SUCCESS"):
                self._rename("__new", "")
            elif self.exists("__old"):
                self._rename("__old", "")
        if self.exists():
            for suffix in ("__new", "__old"):
                self.fs.delete(self.at(suffix), True)

    def replace(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}__new")
        if self.exists():
            self.fs.delete(self.at("__old"), True)
            self._rename("", "__old")
        self._rename("__new", "")
        self.fs.delete(self.at("__old"), True)
        self.spark.catalog.refreshByPath(self.path)


def upsert(source: DataFrame, path: str, keys: Sequence[str], newer: str | None = None) -> None:
    """Upsert into a plain Parquet dataset that is replaced whole (see ``Swap``); a failed run leaves the old data, and
    running again changes nothing. ``tables.KeyedTable`` rewrites only what an upsert touches."""
    spark = source.sparkSession
    check_keys(source, keys)
    swap = Swap(spark, path)
    swap.recover()
    if not swap.exists():
        swap.replace(source)
        return
    target = spark.read.parquet(path)
    if extra := sorted(set(source.columns) - set(target.columns)):
        target = target.withColumns({c: F.lit(None).cast(source.schema[c].dataType) for c in extra})
    swap.replace(merged(target, source, keys, newer))


def backfill(source: DataFrame, table: KeyedTable, day: str, start, end) -> int | None:
    """Upsert the days from ``start`` to ``end`` into a table that is partitioned by ``day``: rows of these days that the
    source lacks stay, and so do all other days. Returns the version, or null where the source has no row of the range."""
    if start > end:
        raise ContractError(f"range is inverted: {start} > {end}")
    if list(table.partition_by) != [day]:
        raise ContractError(f"the table is partitioned by {table.partition_by}, not by {day}")
    part = source.where(F.col(day).between(F.lit(start), F.lit(end)))
    return None if part.isEmpty() else table.upsert(part)


def feature_rows(df: DataFrame, keys: Sequence[str], names: Sequence[str], version: str, as_of) -> DataFrame:
    """Rows of a versioned feature store: features as JSON with explicit nulls, missing count, coverage."""
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    missing = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    return df.select(
        *keys, F.lit(version).alias("feature_version"), F.to_json(values, {"ignoreNullFields": "false"}).alias("f"),
        missing.alias("missing_count"), ((F.lit(len(names)) - missing) / F.lit(len(names))).alias("coverage"), F.lit(as_of).alias("as_of"),
    )
