"""Exact dedup by skew-safe combining, in DataFrame functions only.

A text whose digest no other row has is alone, whatever the digest is worth. Digests are counted first
(one row per task and digest after the partial aggregate), and only rows of digests that recur go on
with their texts. Those are merged in three steps, each of which groups by the whole normalised text
beside its digest, so two texts with one digest never merge:

1. locally: the partial aggregate of the first ``groupBy`` leaves one row for each text and task;
2. by salted digest groups: a digest has as many salts as its rows need (``salt_rows`` a salt), so a text
   that makes up a third of all rows is dealt over as many tasks as that takes;
3. globally: one winner per salt of each text meets.

Rows then find their group by salt, digest and whole text. The table of recurring digests is broadcast up
to ``broadcast_digests`` rows and joined by a shuffle beyond.

Results in odd cases: a null text counts as empty; null ids lose against any other and a group
with only null ids keeps a null; rows that repeat both id and text are the same document, and all
of them carry ``kept`` if that document stays. An empty table gives an empty result. Columns
besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, stage

#: Rows of a table, about 100 bytes each, up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Tasks over which rows of one digest are dealt where the table of digests is not broadcast.
DEAL = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salt_rows: int = 1_000,
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = _sha256,
    broadcast_digests: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal normalised texts the largest id stays. ``digest`` may be weak: texts are compared
    whole when groups merge and when rows find their group.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    rows = text.select("doc_id", "t", digest(F.col("t")).alias("d"))
    again = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    again = stage(again, "exact-digests")
    few = again.count() <= broadcast_digests
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")
    if few:
        marked = rows.join(F.broadcast(again), "d", "left").withColumn("salt", salt)
    else:  # a shuffle by digest alone would meet a hot text in one task
        deal = F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL)).cast("int"))
        marked = dealt.join(again.withColumn("deal", deal), ["d", "deal"], "left").withColumn("salt", salt)
    several = marked.where("salts IS NOT NULL")
    salted = several.groupBy("d", "salt", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"), F.first("salts").alias("salts"))
    groups = salted.groupBy("d", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("group_size"), F.first("salts").alias("salts"))
    groups = stage(groups, "exact-groups")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    found = several.select("doc_id", "d", "t", "salt").join(spread, ["d", "salt", "t"])
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("t", 256).alias("text_sha256")]
    alone = marked.where("salts IS NULL").select("doc_id", "t", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.select(*columns).unionByName(found.select(*columns))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated (id, text) rows once.

    Rows that go are joined away by id and hash of the text, as a broadcast up to ``broadcast_rows`` of them and
    by a shuffle beyond. Names of the columns of ``docs`` may be any.
    """
    judged = stage(exact_dedup(docs, id_col, text_col, **options).select("doc_id", "text_sha256", "kept", "group_size"), "exact-judged")
    gone = judged.where("NOT kept").select("doc_id", "text_sha256")
    normalise = options.get("normalise", ascii_lower)
    sha = F.sha2(normalise(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    kept = rows.join(side, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left_anti")
    repeats = judged.where("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates(["id", "sha"])
    return kept.select("row.*")
