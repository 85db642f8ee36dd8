"""Keyed tables in shared storage: upserts that commit at once, survive crashes and meet other writers.

A table is a folder of Parquet data and a row of manifests:

    data/<commit>/_slot=<slot>/part-*.parquet
    manifests/<version>.json

A slot holds the rows of a partition (``partition_by``, some of the keys) or of a hash bucket of the keys (``buckets``), so
all rows of one key share a slot. A manifest names the folder of every slot, and the schema. An upsert reads and writes
only the slots that its source touches, each to a new folder, and then publishes the next manifest: a file that is
written aside and moved to its name only if that name is free. So readers see the old table or the new one, whole. A
job that dies before it has published leaves nothing but folders that no manifest names. Of two writers that read the same
version one publishes; the other finds the name taken, and keeps its work if their slots differ, or merges anew.

The driver handles slots and manifests, never rows. Their number is bounded by partitions or buckets.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.io import ContractError, check_keys, merged

SLOT = "_slot"


class Conflict(RuntimeError):
    """Other writers kept publishing first."""


class Folder:
    """A folder in any storage that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.at(name))] if self._fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create a file with its whole text; false if it is there already."""
        aside = f"{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self.at(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() != "file":
                return self._fs.rename(self.at(aside), self.at(name))  # refused where the name is taken
            try:  # a local rename replaces what is there, a link does not
                os.link(*[self.at(n).toUri().getPath() for n in (aside, name)])
            except FileExistsError:
                return False
            return True
        finally:
            self.delete(aside)

    def delete(self, name: str) -> None:
        if self._fs.exists(self.at(name)):
            self._fs.delete(self.at(name), True)


class KeyedTable:
    """A table with unique ``keys``, in slots by ``partition_by`` or by ``buckets`` hash buckets.

    The layout of a table that exists is read from it; layouts that are given must agree with it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), partition_by: Sequence[str] = (), buckets: int = 0):
        self.spark, self.folder = spark, Folder(spark, path)
        layout = {"keys": list(keys), "partition_by": list(partition_by), "buckets": buckets}
        if known := self.manifest():
            if keys and known["layout"] != layout:
                raise ContractError(f"the table has the layout {known['layout']}, not {layout}")
            layout = known["layout"]
        self.keys, self.partition_by, self.buckets = layout["keys"], layout["partition_by"], layout["buckets"]
        self.layout = layout
        if not self.keys:
            raise ContractError(f"no table at {path}")
        if set(self.partition_by) - set(self.keys):
            raise ContractError(f"partition columns must be keys: {sorted(set(self.partition_by) - set(self.keys))}")
        if bool(self.partition_by) == bool(self.buckets):
            raise ContractError("a table has partition columns or buckets")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of a version; null for a table that has none."""
        known = self.versions()
        if version is None and not known:
            return None
        return json.loads(self.folder.read(f"manifests/{(known[-1] if version is None else version):012d}.json"))

    def slot(self) -> Column:
        """Slot of a row, as text: a function of the key alone."""
        if self.buckets:
            return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        return F.sha1(F.to_json(F.struct(*self.partition_by), {"ignoreNullFields": "false"}))

    def _slots(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self.slot()).distinct().collect()]  # one per partition or bucket

    def _read(self, manifest: dict, slots: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder.path}/{p}" for s, p in manifest["slots"].items() if slots is None or s in set(slots)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, partitions: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The table, or those of its slots that hold the keys or partition values in ``partitions``; at the newest version
        or an earlier one."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ContractError(f"no table at {self.folder.path}")
        return self._read(manifest, None if partitions is None else self._slots(partitions))

    def _write(self, rows: DataFrame, slots: Sequence[str]) -> dict[str, str]:
        """Folders of the slots' new rows. Each slot is dealt by a hash of its key over tasks, so a large one is no single task's."""
        at = f"data/{uuid.uuid4().hex}"
        rows.withColumn(SLOT, self.slot()).write.partitionBy(SLOT).parquet(f"{self.folder.path}/{at}")
        written = {n.partition("=")[2] for n in self.folder.names(at)}
        return {s: f"{at}/{SLOT}={s}" for s in slots if s in written}

    def upsert(self, source: DataFrame, newer: str | None = None, tries: int = 10, before_publish: Callable[[], None] | None = None) -> int:
        """Matched rows take the source's columns and keep the others, new rows are added, new columns are null elsewhere.
        Running it again changes nothing. Returns the version that holds the source. ``before_publish`` is called in front of
        each attempt to publish (tests use it)."""
        check_keys(source, self.keys)
        touched = self._slots(source)
        base, done = self.manifest(), None
        if not touched and base:
            return base["version"]
        for _ in range(tries):
            if done is None:
                target = self._read(base, touched) if base else self.spark.createDataFrame([], source.schema)
                extra = [c for c in source.columns if c not in target.columns]
                target = target.withColumns({c: F.lit(None).cast(source.schema[c].dataType) for c in extra}) if extra else target
                rows = merged(target, source, self.keys, newer)
                done = self._write(rows, touched)
            schema = _widened(T.StructType.fromJson(base["schema"]) if base else T.StructType(), rows.schema)
            version = base["version"] + 1 if base else 1
            slots = ({s: p for s, p in base["slots"].items() if s not in set(touched)} if base else {}) | done
            if before_publish:
                before_publish()
            text = json.dumps({"version": version, "layout": self.layout, "schema": schema.jsonValue(), "slots": slots})
            if self.folder.publish(f"manifests/{version:012d}.json", text):
                return version
            latest = self.manifest()
            old = base["slots"] if base else {}
            if any(latest["slots"].get(s) != old.get(s) for s in touched):
                done = None  # another writer was in the same slots
            base = latest
        raise Conflict(f"{tries} attempts to write {self.folder.path} met other writers")

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep`` and the data that only they name; returns the number of folders deleted.
        For times without writers, whose unpublished folders look like those of a crash."""
        versions = self.versions()
        kept = {p.split("/")[1] for v in versions[-keep:] for p in self.manifest(v)["slots"].values()}
        gone = [n for n in self.folder.names("data") if n not in kept]
        for v in versions[:-keep]:
            self.folder.delete(f"manifests/{v:012d}.json")
        for n in gone:
            self.folder.delete(f"data/{n}")
        return len(gone)


def _widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """Fields of both; all may be null."""
    fields = {f.name: f for f in (*old.fields, *[f for f in new.fields if f.name not in old.names])}
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])
