"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Pieces of work that run at once: each waits on the latency of its jobs, and leaves cores to those beside it.
PARALLEL = 10


def at_once(spark: SparkSession, work: Callable, tasks: Sequence) -> list:
    """``work`` of every task, ``PARALLEL`` at once. Each call is wrapped by itself: calls that share one wrapping share their
    local properties, in which Spark notes the running query of a thread."""
    calls = [inheritable_thread_target(spark)(partial(work, task)) for task in tasks]
    with ThreadPool(PARALLEL) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset (tests on one machine) a temporary folder takes its
    place, which then is the session's checkpoint folder."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder, in the same partitions: tasks that read it again and again carry no plan of how
    it came about."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a copy that outlives any executor, and no lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
