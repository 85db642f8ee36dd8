"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, tokens=2048)


def op2_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position")
    )


OP4_SQL = r"""
WITH s AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
n AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS class
  FROM s GROUP BY source),
w AS (
  SELECT *, CASE class WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM n),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
          / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, class, source_size,
         CASE WHEN cap / weight > level
              THEN (SELECT max(level) FROM l AS f WHERE f.cap / f.weight > f.level) * weight ELSE cap END AS target
  FROM l),
d AS (
  SELECT s.doc_id, s.size, t.class, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS wanted,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS whole FROM d),
q AS (
  SELECT *, greatest(0, least(size, wanted - whole * source_size - start)) AS part FROM p),
r AS (
  SELECT *, (start::DOUBLE + (CASE WHEN whole > 0 THEN size ELSE part END)::DOUBLE / 2.0::DOUBLE) / wanted::DOUBLE AS share FROM q)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
       CASE WHEN size > 0 AND whole * size + part > 0 THEN round(
         CASE class WHEN 0 THEN 2.0::DOUBLE * (share * 5.0::DOUBLE) / (4.0::DOUBLE + sqrt(16.0::DOUBLE + 4.0::DOUBLE * (share * 5.0::DOUBLE)))
                    WHEN 1 THEN 2.0::DOUBLE * (share * 2.0::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE))
                    ELSE 2.0::DOUBLE * share / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * share)) END, 6) END AS position
FROM r
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.phrase_dedup import remove_repeated

    return remove_repeated(_table(spark, sf_dir, "documents")).drop("kept_text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import remove_repeated

    return remove_repeated(_table(spark, sf_dir, "documents")).drop("kept")



def _planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents, by a hash of the id, words repeat with a period from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n = F.size("w")
    spots = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    a, p, n = F.col("a").cast("int"), F.col("p").cast("int"), F.size("w")
    unit = F.slice("w", a + 1, p)
    rest = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return spots.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", F.lit(1), a), rest), " ")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.word_runs import greatest, listed, word_runs

    found = word_runs(_planted(_table(spark, sf_dir, "documents")), least=12).withColumn("top", greatest(F.col("runs")))
    top = F.col("top")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-top["back"]).alias("start"), top["length"].alias("length"), (-top["short"]).alias("period"),
        F.floor(1000 * top["length"] / -top["short"]).cast("long").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import RULES, listed, scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in RULES]
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in kinds], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fill_middle import fill_in_middle, restored

    out = fill_in_middle(_table(spark, sf_dir, "documents"), seed=42)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
k AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
         array_to_string(u[greatest(k1, k2) + 1:], '') AS s
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_kmeans_tree_neighbours": op2_kmeans_tree_neighbours,
    "op3_unigram_token_counts": op3_unigram_token_counts,
    "op4_curriculum_mixing": op4_curriculum_mixing,
    "op5_token_files": op5_token_files,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_phrase_dedup": op9_phrase_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {"op4_curriculum_mixing": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op13_fill_in_middle": OP13_SQL}
