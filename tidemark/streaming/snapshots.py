"""Quote snapshots as a stream: dedupe, latest per key, consensus with an age limit, upserts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.latest import latest
from tidemark.sources.tables import Folder, KeyedTable

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, with ``captured_at`` as an instant in UTC."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("captured_at", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, id_col: str, at: str, late: str = "2 hours") -> DataFrame:
    """First row of each id; state is dropped once the watermark has passed it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def latest_by_key(stream: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str]) -> DataFrame:
    """Latest fields per key (update or complete mode). An older row that comes late changes nothing."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(at, *fields), F.col(at)).alias("_l")).select(*keys, "_l.*")


def tumbling(stream: DataFrame, at: str, value: str, width: str = "10 minutes") -> DataFrame:
    """Count and mean per window; the same plan on a static table gives the same rows."""
    w = stream.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("w.start").alias("start"), "n", "mean")


class ConsensusProcessor(StatefulProcessor):
    """Newest quote per book of one matchup, with the books' median; a quote that is older than the one held never
    replaces it, and books whose quote is too old leave.

    A quote is too old once the matchup's newest quote, or the stream's watermark, is ``max_age`` past it. A timer
    stands at the time when the oldest held quote gets so old, so books leave while only time passes. Once
    the last has left, the matchup has no state.
    """

    def __init__(self, max_age: float, least: int):
        self.max_age, self.least = max_age, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.books = handle.getMapState("books", T.StructType().add("book", "string"), T.StructType().add("at", "double").add("p", "double"))

    def _stored(self) -> dict[str, tuple[float, float]]:
        """Quotes by book. The state is another process's: it is asked once for all of a matchup's books, not for each row."""
        return {k[0]: (v[0], v[1]) for k, v in self.books.iterator()} if self.books.exists() else {}

    def _settled(self, key, timers, stored: dict, held: dict) -> pd.DataFrame:
        """Drop what is too old, store what has changed, set the timer, and tell what is left."""
        now = max([timers.getCurrentWatermarkInMs() / 1000, *[at for at, _ in held.values()]])
        fresh = {book: quote for book, quote in held.items() if now - quote[0] <= self.max_age}
        for book in stored:
            if book not in fresh:
                self.books.removeKey((book,))
        for book, quote in fresh.items():
            if stored.get(book) is not quote:
                self.books.updateValue((book,), quote)
        wanted = [math.floor((min(at for at, _ in fresh.values()) + self.max_age) * 1000) + 1] if fresh else []
        known = list(self.handle.listTimers())
        for timer in known:
            if timer not in wanted:
                self.handle.deleteTimer(timer)
        for timer in wanted:
            if timer not in known:
                self.handle.registerTimer(timer)
        median = float(pd.Series([p for _, p in fresh.values()]).median()) if len(fresh) >= self.least else None
        return pd.DataFrame({"matchup": [key[0]], "as_of": [now], "books_n": [len(fresh)], "p_market": [median]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self._stored()
        held = dict(stored)
        for pdf in rows:
            for book, at, p in zip(pdf["book"], pdf["at"], pdf["p"]):
                if book not in held or at > held[book][0]:
                    held[book] = float(at), float(p)
        yield self._settled(key, timerValues, stored, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored = self._stored()
        yield self._settled(key, timerValues, stored, stored)

    def close(self) -> None:
        pass


def consensus_stream(stream: DataFrame, max_age: float = 600.0, least: int = 2, late: str = "10 minutes") -> DataFrame:
    """``matchup, as_of, books_n, p_market`` from rows ``matchup, book, captured_at, p``: after every batch with rows of a matchup,
    and when its books leave because time has passed. Of the rows of a matchup the one with the largest ``as_of``
    (seconds) holds. State holds one quote per matchup and book; the watermark is ``late`` behind the newest row."""
    out = T.StructType().add("matchup", "long").add("as_of", "double").add("books_n", "long").add("p_market", "double")
    rows = stream.withWatermark("captured_at", late).select("matchup", "book", "captured_at", (F.unix_micros("captured_at") / 1e6).alias("at"), "p")
    return rows.groupBy("matchup").transformWithStateInPandas(
        statefulProcessor=ConsensusProcessor(max_age, least), outputStructType=out, outputMode="Update", timeMode="EventTime"
    )


def replayed(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Rows that ``stream`` puts out until its source is read through, those of earlier runs from one checkpoint too. Executors
    write each batch to its own Parquet folder, so a batch that is run again changes nothing; the folders are
    found by listing ``path``. A column ``batch`` tells a row's batch; in complete mode the last batch counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    spark, names = stream.sparkSession, Folder(stream.sparkSession, path).names("")
    if not names:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    return rows.where(F.col("batch") == max(int(n.partition("=")[2]) for n in names)) if mode == "complete" else rows


def upsert_stream(stream: DataFrame, table: KeyedTable, at: str, checkpoint: str):
    """Stream into a keyed table, batch by batch; a batch rewrites the slots that it touches. Of rows with one key the newest
    by ``at`` stays, within a batch (ties by all columns) and against what is stored, so a batch that is run again
    changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        rows = latest(batch, table.keys, at, [c for c in batch.columns if c not in (*table.keys, at)]).persist()
        try:
            if not rows.isEmpty():
                table.upsert(rows, newer=at)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
