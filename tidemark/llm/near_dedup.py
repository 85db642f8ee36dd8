"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts with one set form a class, and a class is compared
once. Classes whose MinHash values agree in a band may be similar; bands link them into candidate
clusters by star edges (one per member, never pairs). A cluster's members are dealt into blocks
of bounded size, and each pair of blocks is one group: there, pairs that share a band compare
MinHash values a few at a time and are dropped as soon as the posterior probability that their
similarity reaches the threshold falls below ``tolerance``; the rest are verified on the shingle
sets. Groups report for each class the number of texts it is linked to and a spanning star of the
links, so what leaves a group grows with its members and not with its pairs.

With 32 bands of 5 values a pair of similarity 0.8 goes unnoticed with probability 3e-6.

Classes, not ids, are the nodes of all graphs, so rows without id and rows that repeat an id are compared like
any others.

Results in odd cases: texts without words have no set, hence no links, and are classes of their own;
texts of one to four words are one shingle; a row of null id has links like any other and its class is named by the
smallest id in it, null if no row of the class has one; an empty table gives an empty result. Columns besides id and
text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, stage
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import BROADCAST_ROWS
from tidemark.llm.phrase_dedup import word_symbols
from tidemark.llm.tokens import release
from tidemark.llm.windows import grown, mix

ROWS, BANDS = 5, 32
#: Shingles that are compared at a time, which bounds the bit rows of a group.
CHUNK_SHINGLES = 1 << 14
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of all texts, and the end of each text's among them."""
    names, ends = word_symbols(texts)
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    shingles = grown(names, 1, words)
    out = []
    for a, n in zip(starts.tolist(), size.tolist()):
        if n >= words:
            out.append(np.unique(shingles[a : a + n - words + 1]))
        else:
            out.append(grown(names[a : a + n], 1, n) if n else names[:0])
    lengths = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else names[:0]), np.cumsum(lengths)


def set_sums(shingles: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of every set and two sums over its shingles, which together name its class."""
    starts = np.concatenate([[0], ends[:-1]])
    zero = np.zeros(1, np.uint64)  # a list would make the sums floats, which differ by place
    total = np.concatenate([zero, np.cumsum(mix(shingles), dtype=np.uint64)])
    other = np.concatenate([zero, np.cumsum(mix(shingles ^ np.uint64(0x5555)), dtype=np.uint64)])
    return ends - starts, (total[ends] - total[starts]).view(np.int64), (other[ends] - other[starts]).view(np.int64)


def signatures(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash values (documents x hashes) of non-empty sets; empty sets get the largest value."""
    starts = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(ends > starts)
    out = np.full((len(ends), len(_SEEDS)), 0xFFFFFFFF, np.uint32)
    a = 0
    while a < len(some):  # parts that stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(ends[some], starts[some[a]] + (1 << 15), side="right")))
        lo, hi = int(starts[some[a]]), int(ends[some[b - 1]])
        part, cuts = shingles[lo:hi], starts[some[a:b]] - lo
        for i, seed in enumerate(_SEEDS):
            values = (part * seed) >> np.uint64(32)
            out[some[a:b], i] = np.minimum.reduceat(values, cuts)
        a = b
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for j in range(BANDS):
        key = np.full(len(signature), j + 1, np.uint64)
        for i in range(ROWS):
            key = mix(key * np.uint64(31) + signature[:, j * ROWS + i])
        keys[:, j] = key
    return keys


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Smallest number of equal values among ``n`` with P(similarity >= threshold) >= tolerance,
    for a uniform prior: that probability is P(Binomial(n + 1, threshold) <= matches)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def verified_pairs(left: tuple, right: tuple | None, threshold: float, tolerance: float, step: int = 16):
    """Index pairs of similar sets. Each side is ``(signatures, shingles, ends)``; with ``right``
    None, pairs within ``left``."""
    other = left if right is None else right
    keys, keys2 = band_keys(left[0]), band_keys(other[0])
    share = np.zeros((len(keys), len(keys2)), bool)
    for j in range(BANDS):
        share |= keys[:, j][:, None] == keys2[:, j][None, :]
    i, j = np.nonzero(np.triu(share, 1) if right is None else share)
    equal = np.zeros(len(i), np.int64)
    for a in range(0, len(_SEEDS), step):
        equal += (left[0][i, a : a + step] == other[0][j, a : a + step]).sum(axis=1)
        keep = equal >= least_matches(a + step, threshold, tolerance)
        i, j, equal = i[keep], j[keep], equal[keep]
    if not len(i):
        return i, j
    size, size2 = (np.diff(np.concatenate([[0], s[2]])) for s in (left, other))
    names = left[1] if right is None else np.concatenate([left[1], other[1]])
    names, number = np.unique(names, return_inverse=True)
    times = np.bincount(number, minlength=len(names))
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[number]  # shingles of one set match none
    row = np.repeat(np.arange(len(size)), size)
    sides = [(row[at >= 0], at[at >= 0]) for at in [place[: len(left[1])]]]
    if right is not None:
        row, at = np.repeat(np.arange(len(size2)), size2), place[len(left[1]) :]
        sides.append((row[at >= 0], at[at >= 0]))
    both = np.zeros(len(i), np.int64)
    for begin in range(0, int((times > 1).sum()), CHUNK_SHINGLES):  # bit rows over some shingles at a time
        bits = []
        for (row, at), n in zip(sides, (len(size), len(size2))):
            here = (at >= begin) & (at < begin + CHUNK_SHINGLES)
            r, p = row[here], at[here] - begin
            out = np.zeros((n, CHUNK_SHINGLES // 64), np.uint64)
            np.bitwise_or.at(out, (r, p >> 6), np.uint64(1) << (p & 63).astype(np.uint64))
            bits.append(out)
        for a in range(0, len(i), 4096):
            both[a : a + 4096] += np.bitwise_count(bits[0][i[a : a + 4096]] & bits[-1][j[a : a + 4096]]).sum(axis=1, dtype=np.int64)
    good = both >= threshold * (size[i] + size2[j] - both) - 1e-9
    return i[good], j[good]


def star_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _side(table: pa.Table, words: int) -> tuple:
    shingles, ends = shingle_sets(table["text"].combine_chunks(), words)
    return signatures(shingles, ends), shingles, ends


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    block_members: int = 384,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, text_class, n_links, text_key, kept``.

    ``class_id`` is the smallest id of the connected component; ``text_class`` the smallest id among
    texts of the same shingle set; ``n_links`` the number of other rows of similarity at least
    ``threshold``; ``text_key`` a hash of the text, which with the id names the row; ``kept`` whether the row is the
    component's first by (id, hash), null ids last.
    """
    key = F.xxhash64(F.coalesce(text_col, F.lit("")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                shingles, ends = shingle_sets(part.column(2), words)
                size, s0, s1 = set_sums(shingles, ends)
                sig = signatures(shingles, ends)
                offsets = pa.array(np.arange(len(part) + 1) * BANDS, pa.int32())
                keys = pa.array(band_keys(sig).ravel().view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(s0), pa.array(s1),
                     pa.ListArray.from_arrays(offsets, keys)],
                    names=["doc_id", "key", "size", "s0", "s1", "keys"],
                )
        release()

    rows = stage(base.mapInArrow(sketch, "doc_id long, key long, size long, s0 long, s1 long, keys array<long>"), "sketches")
    same = ["size", "s0", "s1"]
    # of a class: its rows, its first row by (id, hash), null ids last, and one set of band keys (they are all alike)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    texts_of = rows.where("size > 0").groupBy(*same).agg(F.min(first).alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    classes = stage(texts_of.withColumn("node", F.monotonically_increasing_id()), "text-classes")  # numbers are fixed when written
    reps = classes.select("node", F.explode("keys").alias("key")).distinct()
    stars = reps.groupBy("key").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = stage(stars, "band-stars")
    edges = salted_join(reps, stars, ["key"], "n", ["node"]).where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    cluster = components(edges)
    members = cluster.join(classes.select("node", "copies", "lead"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = stage(salted_join(members, sizes, ["root"], "m", ["node"]), "members")
    wanted = members.select("node", F.col("lead.doc_id").alias("doc_id"), F.col("lead.key").alias("key"))
    n_members = members.count()
    packs = max(1, -(-n_members // block_members))
    blocks = F.ceil(F.col("m") / block_members).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    members = members.withColumns({"blocks": blocks, "own": own})
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", meets).select(
        "node", "copies",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("pack"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("own", "other")).alias("bi"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("own", "other")).alias("bj"),
        "own",
    )
    # one text of each class that is compared, by its first row; rows that repeat id and text are one text
    side = F.broadcast(wanted) if n_members <= broadcast_rows else wanted
    pick = base.alias("b").join(side.alias("w"), F.col("b.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("b.key") == F.col("w.key")))
    texts = stage(pick.select("w.node", "b.text").dropDuplicates(["node"]), "class-texts")
    held = members.join(texts, "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending")])
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        block, bi, bj = group["own"].to_numpy(), group["bi"][0].as_py(), group["bj"][0].as_py()
        side = _side(group, words)
        if bi == bj:
            i, j = verified_pairs(side, None, threshold, tolerance)
        else:
            left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            i, j = verified_pairs(_pick(side, left), _pick(side, right), threshold, tolerance)
            i, j = left[i], right[j]
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        some = np.flatnonzero(links > 0)
        root = star_of(len(node), i, j)
        return pa.table({"node": node[some], "root": node[root[some]], "links": links[some].astype(np.int64)})

    found = stage(held.groupBy("pack", "bi", "bj").applyInArrow(compare, "node long, root long, links long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = classes.drop("keys").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leads = linked.groupBy("root").agg(F.min("lead").alias("first"), F.count(F.lit(1)).alias("m"))
    known = salted_join(linked, stage(leads, "leads"), ["root"], "m", ["node"]).select(*same, "copies", "links", "lead", "first")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    alone = F.col("copies").isNull()  # no words, hence no set
    sized = stage(known.withColumn("n", F.col("copies")), "classes-known")
    some = salted_join(rows.where("size > 0").drop("keys"), sized, same, "n", ["doc_id", "key"])
    both = some.unionByName(rows.where("size = 0").drop("keys"), allowMissingColumns=True)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("text_class"),
        n_links.alias("n_links"), F.col("key").alias("text_key"), (alone | kept).alias("kept"),
    )


def _pick(side: tuple, rows: np.ndarray) -> tuple:
    signature, shingles, ends = side
    starts = np.concatenate([[0], ends[:-1]])
    parts = [shingles[starts[r] : ends[r]] for r in rows.tolist()]
    lengths = np.array([len(p) for p in parts], np.int64)
    return signature[rows], (np.concatenate(parts) if parts else shingles[:0]), np.cumsum(lengths)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """Rows of ``docs`` without those of another row's group: the first of each by (id, hash of the text) stays, null ids
    last. Rows that repeat id and text share their fate. Names of the columns of ``docs`` may be any."""
    gone = stage(near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select("doc_id", "text_key").distinct(), "near-gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    key = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("key"))
    return rows.join(side, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_anti").select("row.*")
