"""The corpus pipeline on the smallest tables: every stage does what it says to all its rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.near_dedup import near_duplicates

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "exact", "near", "mixing", "packing"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")

    good = steps["quality"](spark, docs, FOLDER).cache()
    want = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns

    single = steps["exact"](spark, good, FOLDER).cache()
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in exact_dedup(good).where("kept").collect()}
    lowered = [r["text"].translate({c: c + 32 for c in range(65, 91)}) for r in single.collect()]
    assert len(set(lowered)) == len(lowered) and single.columns == docs.columns

    near = steps["near"](spark, single, FOLDER).cache()
    assert {r["doc_id"] for r in near.collect()} == {r["class_id"] for r in near_duplicates(single).collect()}
    assert near_duplicates(near).where("n_links > 0").count() == 0 and near.columns == docs.columns

    mixed = steps["mixing"](spark, near, FOLDER).cache()
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3 and mixed.columns == docs.columns

    packed = steps["packing"](spark, mixed, FOLDER).collect()
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}


def test_columns_of_any_name(spark):
    """Extra columns that are named like internal ones pass through every stage, with nulls, repeats and an empty table."""
    from pyspark.sql import functions as F

    names = ["_mix_at", "_mix_id", "_bad_id", "row", "id", "at", "key", "size", "text_key", "text_sha256", "a.b"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.select("*", *[F.lit(n).alias(n) for n in names])
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    steps = dict(corpus_pipeline.STAGES)
    for name in ("quality", "exact", "near", "mixing"):
        got = steps[name](spark, odd, FOLDER)
        assert got.columns == odd.columns and got.count() > 0
        rows = got.select(*[F.col(f"`{n}`") for n in names]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(names)]
        assert steps[name](spark, odd.limit(0), FOLDER).count() == 0
    packed = steps["packing"](spark, odd, FOLDER)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def brute_force(rows, junk, tokenizer):
    """The pieces that the pipeline packs, by each stage's definition on lists of rows (id, text, source)."""
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    rows = [(i, t or "", s) for i, t, s in rows if i not in junk]
    # exact: of equal texts the largest id, null ids last, rows that repeat id and text once
    best = {}
    for i, t, s in rows:
        if lower(t) not in best or best[lower(t)][0] is None or (i is not None and i > best[lower(t)][0]):
            best[lower(t)] = (i, t, s)
    rows = list(best.values())
    # near: of texts linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest id
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(t)
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    groups = {}
    for r, row in zip(root, rows):
        groups.setdefault(r, []).append(row)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    # mixing: sources by code point, null last, weigh 5, 2, 1; at most three times their words
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left, w = sum(size.values()) - sum(target.values()), sum(weight[s] for s in free)
        if not (over := {s for s in free if left * weight[s] / w > 3 * size[s]}):
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    read = []
    for s in names:
        start, wanted = 0, int(target[s] + 0.5)
        whole = wanted // size[s] if size[s] else 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = len(WORD.findall(t))
            part = max(0, min(n, wanted - whole * size[s] - start))
            read += [(i, t)] * (int((whole * n + part) / max(n, 1) + 0.5) if n else 0)
            start += n
    # packing: ids and the end id, cut at 2048
    want = Counter()
    for i, t in read:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[(i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    return want


def prose(rng, n, words):
    return " ".join(rng.choice(words, n)).capitalize() + "."


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_brute_force(spark, tmp_path, seed):
    """The whole pipeline on planted documents: junk, exact copies, near copies, short, empty and very long texts, hot sources,
    clashing names."""
    from tokenizers import Tokenizer

    from tidemark.llm.queries import tokenizer_path

    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(3, 8)))) for _ in range(300)]
    rows = [(i, prose(rng, int(rng.integers(20, 120)), words), ("hot", "hot", "b", "c", None)[i % 5]) for i in range(120)]
    junk = {1000 + i: "".join(rng.choice(list("#$%&@!?*"), 60)) + " " + " ".join("".join(rng.choice(list("0123456789#"), 6)) for _ in range(40)) for i in range(120)}
    rows += [(i, t, "hot") for i, t in junk.items()]
    rows += [(300 + i, rows[i][1].lower() if i % 2 else rows[i][1], "b") for i in range(12)]  # exact copies
    for i in range(12):  # near copies: a word changed in a long text
        w = prose(rng, 150, words).split()
        rows += [(400 + 3 * i + k, " ".join([*w[: 40 * k], f"changed{k}", *w[40 * k + 1 :]]), "c") for k in range(3)]
    rows += [(500, prose(rng, 4000, words), "b"), (501, prose(rng, 3, words), "c"), (500, rows[0][1] + " tail", "b"), rows[5], rows[5]]
    labels = [(i, 1) for i in range(120)] + [(i, 0) for i in junk]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", "1 AS _mix_at", "2 AS `_bad_id`", "3 AS row").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    want = brute_force(rows, set(junk), Tokenizer.from_file(tokenizer_path()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[n for _, n in b]])[:-1].tolist() and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
