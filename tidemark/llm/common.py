"""Helpers that the training-data operators share: staging, words, whole-text access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests on one machine) a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the driver and all executors need a folder that they share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a copy that outlives any executor, so a lost one costs a re-read
    and not the work before it. ``files``: how many files suffice, where the caller knows a bound on the rows.
    """
    path = new_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, text_col: str, target_bytes: int) -> int:
    """Number of partitions of about ``target_bytes`` of text each; one aggregate over all rows."""
    total = df.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // target_bytes))


#: Keys with more than this share of all rows are salted, so at most its inverse of them are broadcast.
HOT_SHARE, HOT_LEAST = 1e-3, 1000


def salted_join(rows: DataFrame, known: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``known``, which has each key once and how many of ``rows`` hold it (``size``).

    Rows of a hot key are dealt over as many tasks as they need by a hash of ``spread``, and the key's one row of
    ``known`` is repeated for each. Hot keys are at most ``1 / HOT_SHARE``, so their table is broadcast.
    """
    total = known.agg(F.sum(size)).first()[0] or 0
    limit = max(HOT_LEAST, int(total * HOT_SHARE))
    salts = F.ceil(F.col(size) / limit).cast("int")
    hot = known.where(F.col(size) > limit).select(*keys, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    each = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(each, [*keys, "_salt"]).drop("_salt")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same where a text has nothing but ASCII, and faster."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, up, up.lower())
    )


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
