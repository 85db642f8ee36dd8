"""A corpus through five operators: quality, exact copies, near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that ``run`` writes as Parquet and reads again for the next.

Results in odd cases: null texts count as empty; rows that repeat id and text are one document and stay once at
most; rows of null id pass like any other; an empty table gives an empty result; columns of any name are kept up to the
last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stage
from tidemark.llm.exact_dedup import keep_exact
from tidemark.llm.mixing import training_order
from tidemark.llm.near_dedup import keep_one
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id (null ids last)."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order."""
    return training_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier has no SQL form. The tests hold every stage against the operator that it calls, and the whole against a
#: brute-force version on planted documents.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
