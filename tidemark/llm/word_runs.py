"""Periodic runs: stretches of words that repeat themselves at least twice, found exactly and in all periods.

A run is a stretch with smallest period q (words q apart are equal) of at least 2 * q and ``least`` words that no
neighbouring word extends. Runs of a stretch of words come from two suffix trees, of the words and
of their reversal, which answer the longest common extension (LCE) of two places to the right and to the
left in constant time. By the runs theorem every run holds a Lyndon root: for one of the two orders of
the values, the longest Lyndon word at some place i is as long as the run's period. These lengths are the
distances to the next smaller suffix; each is a candidate (i, p), extended in both directions by LCE, and is a
run if it comes to 2 * p.

Trees are built only where a run can be. In a run of L words the first L - q words equal the last L - q, and
L - q >= max(least - q, q) >= k, half of ``least``. So windows of k words that stand in the run twice cover all of it. Windows are
hashed, words that no recurring window covers are cut away, and the stretches that are left, which hold all runs whole, are
cut again by the windows that recur in themselves until nothing changes. A false match of hashes only keeps a stretch longer.

Results in odd cases: a null text has no words, no runs and an empty collapsed text; a null id is carried
through; repeated rows are judged each; a text of any length is one row, its trees cost memory in
proportion to its longest stretch (about 600 bytes a word); an empty table gives an empty result. Columns besides id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import parts, words
from tidemark.llm.suffix_tree import SuffixTree

RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_MIX, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def stretches(codes: np.ndarray, group: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches ``[a, b)`` of one group (document) each that hold every run of at least ``least`` words."""
    k = -(-least // 2)
    at, group = np.arange(len(codes)), group.astype(np.uint64)
    codes = codes.astype(np.uint64) + np.uint64(1)
    while len(at) >= least:
        n = len(at) - k + 1
        whole = (group[k - 1 :] == group[:n]) & (at[k - 1 :] - at[:n] == k - 1)
        name = group[:n] * _ADD
        for j in range(k):
            name = (name ^ (name >> np.uint64(29))) * _MIX + codes[at[j : n + j]] * _ADD
        name, place = name[whole], np.flatnonzero(whole)
        _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
        edge = np.zeros(len(at) + 1, np.int32)
        hits = place[count[inverse] > 1]
        edge[hits] += 1
        edge[hits + k] -= 1
        keep = np.cumsum(edge[:-1]) > 0
        # a stretch ends where the next place is not kept, or belongs to another group
        left = np.flatnonzero(keep)
        new = np.ones(len(left), bool)
        new[1:] = (np.diff(left) > 1) | (np.diff(at[left]) > 1) | (group[left][1:] != group[left][:-1])
        label = np.cumsum(new)
        wide = np.bincount(label)[label] >= least
        left, label = left[wide], label[wide]
        done = len(left) == len(at) and len(np.unique(label)) == len(np.unique(group))
        at, group = at[left], label.astype(np.uint64)
        if done:
            break
    else:
        return []
    cut = np.flatnonzero(np.diff(group)) + 1
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip([0, *cut], [*cut, len(at)])]


def _lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place but the last: the distance to the next smaller suffix."""
    ranks, out, open_ = rank.tolist(), np.zeros(len(rank), np.int64), []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            j = open_.pop()
            out[j] = i - j
        open_.append(i)
    return out[:-1]


def runs_of(codes: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of a sequence of integers, by start, then period."""
    values = np.unique(codes, return_inverse=True)[1]
    n = len(values)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    right, left = SuffixTree(values), SuffixTree(values[::-1])
    i = np.tile(np.arange(n), 2)
    p = np.concatenate([_lyndon(right.rank), _lyndon(right.falling_rank())])
    inside = i + p < n
    i, p = i[inside], p[inside]
    end = i + p + right.common(i, i + p)
    start = i - left.common(n - i, n - i - p)
    good = (end - start >= 2 * p) & (end - start >= least)
    # one run has many roots; start and period name it, and it is as long from each of them
    return np.unique(np.stack([start, p, end - start], 1)[good], axis=0)[:, [0, 2, 1]]


def _rows(ids: pa.Array, texts: pa.Array, least: int) -> pa.RecordBatch:
    flat, at = words(texts)
    n = len(flat)
    codes = flat.dictionary_encode().indices.to_numpy() if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    gone, found, owner = np.zeros(n + 1, np.int64), [], []
    for a, b in stretches(codes, doc, least):
        rows = runs_of(codes[a:b], least)
        rows[:, 0] += a
        np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
        np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
        rows[:, 0] -= at[doc[a]]
        found.append(rows)
        owner.append(np.full(len(rows), doc[a]))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    each = np.bincount(np.concatenate(owner), minlength=len(texts)) if owner else np.zeros(len(texts), np.int64)
    # stretches come in the order of places, so rows are in order already
    structs = pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(3)], ["start", "length", "period"])
    kept = np.cumsum(gone[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[at]
    left = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat.filter(pa.array(kept)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), structs), pc.binary_join(left, pa.scalar(" ", flat.type)).cast(pa.string())],
        names=["doc_id", "runs", "collapsed"],
    )


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per document: ``doc_id``, its ``runs`` (start, length, period, in words from 0) by start, then period,
    and ``collapsed``, its words without those that a run holds after its first period, joined by blanks."""
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in parts(batch.column(1)):
                yield _rows(batch.column(0).slice(a, len(texts)), texts, least)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed of each run."""
    text = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return F.array_join(F.transform(runs, text), "")


def greatest(runs: Column) -> Column:
    """The longest run; of several the one with the smallest start, then period. Null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
