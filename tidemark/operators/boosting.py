"""Boosted trees for the logistic loss, grown from histograms of binned rows.

The trees are those of Spark ML's ``GBTClassifier``: regression trees by variance on the gradient, levels at once, of which the
first counts whole and the others by ``step``; splits lie at Spark's strides of the counted values, here of all rows and not of
a sample. What differs is where the work is done. A fit is two passes and one stage: the first pass counts values, the
second bins rows into two bytes for each two columns, and the tasks of the stage, which Spark starts together (a barrier stage), hold
their share of the rows from then on. They exchange their histograms and all find the same splits, so a level is a message and not a
job, and rows stay where they are. Held rows travel along, and their loss after each round says when to stop. Messages are files in
the shared folder where executors see it as a path, and else Spark's ``allGather``, which takes a second each.

A column and its missing flag are one code: missing rows have the imputed value and a code of their own. Two columns share a
histogram over pairs of codes. Of two children only the smaller is counted, the other is what remains of their parent.
"""

from __future__ import annotations

import base64
import os
import pickle
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Condition
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.io import ContractError
from tidemark.sources.scratch import new_path

#: Most bins of a column, and levels below a root.
BINS, DEPTH = 32, 6
#: Values by which a task tells a column's distribution: more are merged to as many, evenly by rows.
KNOTS = 10_000
#: Rows whose histograms are counted at a time.
CHUNK = 1 << 16
#: A gain below this share of a node's squared mean is rounding: all rows of the node are alike.
ROUNDING = 1e-9
#: Most seconds between two looks for the messages of others.
LOOK = 0.005


@dataclass(frozen=True)
class Settings:
    """How trees grow: ``most`` rounds, or fewer where ``patience`` rounds in turn brought held rows no gain (0: never)."""

    most: int
    patience: int = 0
    step: float = 0.05
    sample: float = 0.8
    columns: float = 0.8
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, the root first: split column (-1: a leaf) and threshold, children, and rows, sum and squares of the gradient."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    squares: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, rows: float, total: float) -> int:
        for values, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.rows, rows), (self.total, total), (self.squares, 0.0), (self.gain, 0.0)):
            values.append(v)
        return len(self.rows) - 1


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Round of the smallest loss until ``patience`` rounds in turn brought no gain, and whether that ended it."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


# ---- bins ---------------------------------------------------------------------------------------


def splits_of(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between sorted distinct ``values``: all midpoints, or those nearest to even strides of rows."""
    with np.errstate(invalid="ignore"):
        middles = (values[:-1] + values[1:]) / 2
    if len(middles) >= bins:
        upto = np.cumsum(counts, dtype=float)
        nearer = (upto[:-1] + upto[1:]) / 2  # beyond it a target is nearer to the next value's end
        stride, kept, at = upto[-1] / bins, [], 0
        target = stride
        while (at := max(at, int(np.searchsorted(nearer, target, "right")))) < len(middles):
            kept.append(middles[at])
            target, at = target + stride, at + 1
        middles = np.array(kept)
    return middles[~np.isnan(middles)]


def merged(values: np.ndarray, counts: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with their counts; beyond ``most``, the last value of each of as many even stretches of rows."""
    known, where = np.unique(values, return_inverse=True)
    counts = np.bincount(where, weights=counts, minlength=len(known))
    if most and len(known) > most:
        upto = np.cumsum(counts)
        ends = np.unique(np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, most + 1) / most), len(known) - 1))
        known, counts = known[ends], np.diff(upto[ends], prepend=0.0)
    return known, counts


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _surveys(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows to learn, per column: values and counts, rows, missing ones, and rows whose label is no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        rows, odd, missing = 0, 0, np.zeros(n, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            label = _numbers(batch.column(2 * n))
            rows, odd = rows + len(label), odd + int(np.sum(~((label == 0) | (label == 1))))
            for j in range(n):
                held[j].append((_numbers(batch.column(j)), np.ones(batch.num_rows)))
                missing[j] += int(np.sum(_numbers(batch.column(n + j)) > 0))
                if len(held[j]) >= 32:
                    held[j] = [merged(*map(np.concatenate, zip(*held[j])), 32 * KNOTS)]
        for j in range(n) if rows else ():
            values, counts = merged(*map(np.concatenate, zip(*held[j])), KNOTS)
            held[j] = []
            yield pa.RecordBatch.from_pylist([{"column": j, "values": values.tobytes(), "counts": counts.tobytes(), "rows": rows, "missing": int(missing[j]), "odd": odd}], schema=SURVEY)

    return run


SURVEY = pa.schema([("column", pa.int32()), ("values", pa.binary()), ("counts", pa.binary()), ("rows", pa.int64()), ("missing", pa.int64()), ("odd", pa.int64())])
_SPLITS = pa.schema([("column", pa.int32()), ("splits", pa.list_(pa.float64())), ("rows", pa.int64()), ("missing", pa.int64()), ("odd", pa.int64())])


def _split_columns(surveys: pa.Table) -> pa.Table:
    """Thresholds of one column from the surveys of all tasks."""
    numbers = lambda name: np.concatenate([np.frombuffer(b.as_py()) for b in surveys[name]])
    values, counts = merged(numbers("values"), numbers("counts"))
    add = lambda name: sum(surveys[name].to_pylist())
    return pa.Table.from_pylist([{"column": surveys["column"][0].as_py(), "splits": splits_of(values, counts, min(BINS, max(add("rows"), 1))).tolist(), "rows": add("rows"), "missing": add("missing"), "odd": add("odd")}], schema=_SPLITS)


@dataclass(frozen=True)
class Layout:
    """Codes of columns: ``splits`` by column, the code of the value that missing rows have, and whether the flag tells rows apart."""

    splits: list[np.ndarray]
    imputed: list[int]
    flagged: list[bool]

    @property
    def widths(self) -> list[int]:
        return [len(s) + 2 for s in self.splits]  # a bin more than splits, and missing rows

    def pairs(self) -> list[tuple[int, ...]]:
        n = len(self.splits)
        return [tuple(range(j, min(j + 2, n))) for j in range(0, n, 2)]

    def pair_widths(self) -> list[tuple[int, int]]:
        w = self.widths
        return [(w[p[0]], w[p[1]] if len(p) > 1 else 1) for p in self.pairs()]

    def coded(self, values: Sequence[np.ndarray], flags: Sequence[np.ndarray]) -> np.ndarray:
        codes = [np.where(f > 0, len(s) + 1, np.searchsorted(s, v, "left")).astype(np.uint16) for s, v, f in zip(self.splits, values, flags)]
        return np.stack([codes[p[0]] * np.uint16(wb) + (codes[p[1]] if len(p) > 1 else np.uint16(0)) for p, (_, wb) in zip(self.pairs(), self.pair_widths())])


_BINNED = pa.schema([("task", pa.int32()), ("place", pa.int32()), ("rows", pa.int32()), ("codes", pa.binary()), ("label", pa.binary()), ("held", pa.binary())])


def _binned(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n = len(layout.splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            if batch.num_rows:
                codes = layout.coded([_numbers(batch.column(j)) for j in range(n)], [_numbers(batch.column(n + j)) for j in range(n)])
                label, held = _numbers(batch.column(2 * n)), _numbers(batch.column(2 * n + 1)).astype(np.uint8)
                if not np.all((label == 0) | (label == 1)):
                    raise ValueError("a held row has a label other than 0 and 1")
                label = label.astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"task": task, "place": place, "rows": batch.num_rows, "codes": codes.tobytes(), "label": label.tobytes(), "held": held.tobytes()}], schema=_BINNED)

    return run


# ---- trees --------------------------------------------------------------------------------------


class _Rows:
    """Rows of a task, all to learn or all held: codes by pair, label as 1 or -1, score so far and place in the tree that grows."""

    def __init__(self, codes: np.ndarray, label: np.ndarray):
        self.codes, self.n = np.ascontiguousarray(codes), codes.shape[1]
        self.sign = np.where(label > 0, np.int8(1), np.int8(-1))
        self.score, self.node = np.zeros(self.n), np.zeros(self.n, dtype=np.uint8)
        self.gradient, self.drawn = np.zeros(0), np.zeros(0, dtype=bool)

    def advance(self, table: np.ndarray, pair_of: np.ndarray, splits: np.ndarray, some: bool) -> None:
        """To the child, for rows whose node was split; ``some``: these are few."""
        at = np.flatnonzero(splits[self.node]) if some else np.arange(self.n)
        node = self.node[at] if some else self.node
        place = (pair_of * self.n)[node]
        place += at
        index = (np.arange(len(pair_of)) * table.shape[1])[node]
        index += self.codes.reshape(-1).take(place)
        if some:
            self.node[at] = table.reshape(-1).take(index)
        else:
            self.node = table.reshape(-1).take(index)


def _chunks(blobs: list[tuple], n_pairs: int) -> tuple[list[_Rows], list[_Rows]]:
    """Rows to learn and held ones, in the order of their tasks and places."""
    out: tuple[list[_Rows], list[_Rows]] = ([], [])
    waiting: tuple[list, list] = ([], [])
    blobs.sort(key=lambda b: b[:2], reverse=True)

    def close(part: int) -> None:
        if waiting[part]:
            codes, labels = zip(*waiting[part])
            out[part].append(_Rows(np.concatenate(codes, axis=1), np.concatenate(labels)))
            waiting[part].clear()

    while blobs:
        _, _, n, codes, label, held = blobs.pop()
        codes, label, held = np.frombuffer(codes, np.uint16).reshape(n_pairs, n), np.frombuffer(label, np.uint8), np.frombuffer(held, np.uint8) > 0
        for part, on in ((0, ~held), (1, held)):
            if on.any():
                waiting[part].append((codes[:, on], label[on]))
                if sum(len(x) for _, x in waiting[part]) >= CHUNK:
                    close(part)
    close(0)
    close(1)
    return out


class _Growth:
    """Trees from the rows of one task and, by ``gather``, those of all."""

    def __init__(self, layout: Layout, settings: Settings, learn: list[_Rows], held: list[_Rows], task: int, gather: Callable[[np.ndarray], np.ndarray]):
        self.layout, self.settings, self.learn, self.held, self.task, self.gather = layout, settings, learn, held, task, gather
        self.pairs, self.pair_widths = layout.pairs(), layout.pair_widths()
        self.width = max(a * b for a, b in self.pair_widths)
        self.offsets = np.concatenate([[0], np.cumsum(layout.widths)])
        n = len(layout.splits)
        # candidates in order: the splits of every column, and the flags that tell rows apart, by Spark's number of their feature
        self.candidates = [(j, k) for j, s in enumerate(layout.splits) for k in range(len(s))] + [(n + j, 0) for j in range(n) if layout.flagged[j]]
        self.feature_of = np.array([f for f, _ in self.candidates], dtype=int)

    def counted(self, slot_of: np.ndarray, slots: int) -> np.ndarray:
        """Sums and counts of the drawn rows whose node has a slot: ``[2, slots, codes of all columns]``, of all tasks."""
        sums, counts = np.zeros((len(self.pairs), slots * self.width)), np.zeros((len(self.pairs), slots * self.width), dtype=np.int64)
        asked = slot_of >= 0
        base_of = np.maximum(slot_of, 0) * self.width
        for rows in self.learn:
            at = np.flatnonzero(asked[rows.node] & rows.drawn)
            base, weights = base_of[rows.node[at]], rows.gradient[at]
            for p in range(len(self.pairs)):
                index = base + rows.codes[p].take(at)
                sums[p] += np.bincount(index, weights, slots * self.width)
                counts[p] += np.bincount(index, minlength=slots * self.width)
        out = np.zeros((2, slots, self.offsets[-1]))
        for p, (columns, (a, b)) in enumerate(zip(self.pairs, self.pair_widths)):
            for k, held in enumerate((sums, counts)):
                both = held[p].reshape(slots, self.width)[:, : a * b].reshape(slots, a, b)
                for axis, j in zip((2, 1), columns):
                    out[k, :, self.offsets[j] : self.offsets[j + 1]] = both.sum(axis=axis)
        return self.gather(out)

    def lefts(self, hist: np.ndarray) -> np.ndarray:
        """Sums and counts left of each candidate: ``[2, nodes, candidates]``. Additions in one order, so that all tasks agree."""
        out, flags = [], []
        for j, splits in enumerate(self.layout.splits):
            codes = hist[:, :, self.offsets[j] : self.offsets[j + 1]]
            bins = codes[:, :, :-1].copy()
            bins[:, :, self.layout.imputed[j]] += codes[:, :, -1]
            upto = np.cumsum(bins, axis=2)
            out.append(upto[:, :, : len(splits)])
            if self.layout.flagged[j]:
                flags.append((upto[:, :, -1] - codes[:, :, -1])[:, :, None])
        return np.concatenate(out + flags, axis=2)

    def best(self, tree: Tree, nodes: Sequence[int], hist: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, float, float] | None]:
        """Per node the best candidate among the columns that are drawn for it, its gain, and sum and count to its left."""
        n = 2 * len(self.layout.splits)
        drawn = np.argsort(rng.random((len(nodes), n)), axis=1)[:, : int(np.ceil(self.settings.columns * n))]
        open_to = np.zeros((len(nodes), n), dtype=bool)
        np.put_along_axis(open_to, drawn, True, axis=1)
        if not self.candidates:
            return [None] * len(nodes)
        sums, counts = self.lefts(hist)
        total, rows = (np.array([x[v] for v in nodes])[:, None] for x in (tree.total, tree.rows))
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = sums * sums / counts + (total - sums) * (total - sums) / (rows - counts) - total * total / rows
        gains = np.where((counts >= 1) & (rows - counts >= 1) & open_to[:, self.feature_of], gains, -np.inf)
        out = []
        for i, c in enumerate(np.argmax(gains, axis=1)):
            found = gains[i, c] > max(ROUNDING * total[i, 0] ** 2 / rows[i, 0], 0.0)
            out.append((int(c), float(gains[i, c] / rows[i, 0]), float(sums[i, c]), float(counts[i, c])) if found else None)
        return out

    def goes_left(self, candidate: int) -> tuple[int, np.ndarray]:
        """The pair that tells, and by its code whether a row goes left."""
        feature, k = self.candidates[candidate]
        n = len(self.layout.splits)
        j = feature % n
        codes = np.arange(self.layout.widths[j])
        missing = codes == len(codes) - 1
        left = ~missing if feature >= n else np.where(missing, self.layout.imputed[j], codes) <= k
        p = j // 2
        a, b = self.pair_widths[p]
        both = np.broadcast_to(left[:, None], (a, b)) if j == self.pairs[p][0] else np.broadcast_to(left[None, :], (a, b))
        return p, both.reshape(-1)

    def grown(self, number: int) -> Tree:
        """A tree on the gradients, all rows left at their leaves."""
        tree, table = Tree(), np.zeros((2 ** (DEPTH + 1), self.width), dtype=np.uint8)
        pair_of = np.zeros(len(table), dtype=np.int64)
        slot_of = np.full(len(table), -1)
        slot_of[0] = 0
        hist = self.counted(slot_of, 1)
        first = hist[:, 0, : self.offsets[1]].cumsum(axis=1)[:, -1]
        level, known = [tree.add(float(first[1]), float(first[0]))], {0: hist[:, 0]}
        for depth in range(DEPTH):
            rng = np.random.default_rng([self.settings.seed, number, depth])
            found = self.best(tree, level, np.stack([known[v] for v in level], axis=1), rng) if level else []
            split = {v: x for v, x in zip(level, found) if x}
            if not split:
                break
            for v, (c, gain, total, rows) in split.items():
                feature, k = self.candidates[c]
                tree.feature[v], tree.gain[v] = feature, gain
                tree.threshold[v] = 0.5 if feature >= len(self.layout.splits) else float(self.layout.splits[feature][k])
                tree.left[v], tree.right[v] = tree.add(rows, total), tree.add(tree.rows[v] - rows, tree.total[v] - total)
                pair_of[v], left = self.goes_left(c)
                table[v, : len(left)] = np.where(left, tree.left[v], tree.right[v])
                for child in (tree.left[v], tree.right[v]):
                    table[child] = child
            splits = np.zeros(len(table), dtype=bool)
            splits[list(split)] = True
            some = 2 * sum(tree.rows[v] for v in split) < tree.rows[0]
            for rows in (*self.learn, *self.held):
                rows.advance(table, pair_of, splits, some)
            if depth + 1 == DEPTH:
                break
            below = [v for v in split if max(tree.rows[tree.left[v]], tree.rows[tree.right[v]]) > 1]
            smaller = [tree.left[v] if tree.rows[tree.left[v]] <= tree.rows[tree.right[v]] else tree.right[v] for v in below]
            parents, known, level = known, {}, []
            if not below:
                break
            slot_of[:] = -1
            slot_of[smaller] = np.arange(len(smaller))
            hist = self.counted(slot_of, len(smaller))
            for i, (v, small) in enumerate(zip(below, smaller)):
                large = tree.left[v] + tree.right[v] - small
                known[small], known[large] = hist[:, i], parents[v] - hist[:, i]
                level += [c for c in (tree.left[v], tree.right[v]) if tree.rows[c] > 1]
        return tree

    def run(self) -> tuple[list[Tree], list[float]]:
        trees, losses, done = [], [], False
        s = self.settings
        for number in range(s.most):
            rng = np.random.default_rng([s.seed, number, self.task, 1 << 20])
            for rows in self.learn:  # the first tree learns the labels, the others the gradient of twice the log-loss
                rows.gradient = rows.sign.astype(float) if number == 0 else _gradient(rows)
                rows.drawn = rng.random(rows.n, dtype=np.float32) < s.sample
                rows.node = np.zeros(rows.n, dtype=np.uint8)
            for rows in self.held:
                rows.node = np.zeros(rows.n, dtype=np.uint8)
            tree = self.grown(number)
            n = len(tree.rows)
            values = np.array([t / r if r else 0.0 for t, r in zip(tree.total, tree.rows)]) * (s.step if number else 1.0)
            told = np.zeros(n + 2)  # squares by leaf, loss and number of held rows
            for rows in self.learn:
                told[:n] += np.bincount(rows.node, np.where(rows.drawn, rows.gradient * rows.gradient, 0.0), n)
            for rows in (*self.learn, *self.held):
                rows.score += values[rows.node]
            for rows in self.held:
                told[n] += np.logaddexp(0.0, -2.0 * rows.sign * rows.score).sum()
                told[n + 1] += rows.n
            told = self.gather(told)
            tree.squares = told[:n].tolist()
            for v in range(n - 1, -1, -1):  # children have larger numbers
                if tree.feature[v] >= 0:
                    tree.squares[v] = tree.squares[tree.left[v]] + tree.squares[tree.right[v]]
            trees.append(tree)
            if told[n + 1]:
                losses.append(float(told[n] / told[n + 1]))
                done = bool(s.patience) and best_round(losses, s.patience)[1]
            if done:
                break
        return trees, losses


def _gradient(rows: _Rows) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 4.0 * rows.sign / (1.0 + np.exp(2.0 * rows.sign * rows.score))


class _Meeting:
    """Sums over all tasks of a barrier stage, by files ``message-task`` in a folder; ``None``: by ``allGather``."""

    def __init__(self, context, tasks: int, folder: str | None):
        self.context, self.tasks, self.own, self.message = context, tasks, context.partitionId(), 0
        attempt = context.allGather(uuid.uuid4().hex)[0]  # a stage that runs again meets elsewhere
        self.folder = folder and f"{folder}-{attempt}"
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)

    def path(self, message: int, task: int) -> str:
        return f"{self.folder}/{message}-{task}"

    def all(self, own: bytes) -> Iterator[bytes]:
        """The messages of all tasks, in their order."""
        if not self.folder:
            yield from (base64.b64decode(text) for text in self.context.allGather(base64.b64encode(own).decode()))
            return
        with open(self.path(self.message, self.own) + ".new", "wb") as f:
            f.write(own)
        os.rename(f.name, self.path(self.message, self.own))
        for task in range(self.tasks):
            wait = LOOK / 32
            while not os.path.exists(self.path(self.message, task)):
                time.sleep(wait)
                wait = min(LOOK, 2 * wait)
            with open(self.path(self.message, task), "rb") as f:
                yield f.read()
        if self.message:  # whoever wrote this message has read the one before
            os.remove(self.path(self.message - 1, self.own))
        self.message += 1

    def gather(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(own.size)
        for data in self.all(np.ascontiguousarray(own).tobytes()):
            out += np.frombuffer(data)
        return out.reshape(own.shape)


def _grows(layout: Layout, settings: Settings, tasks: int, folder: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext, TaskContext

        context = BarrierTaskContext.get() if tasks > 1 else TaskContext.get()
        gather = _Meeting(context, tasks, folder).gather if tasks > 1 else lambda own: own
        blobs = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        learn, held = _chunks(blobs, len(layout.pairs()))
        trees, losses = _Growth(layout, settings, learn, held, context.partitionId(), gather).run()
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pylist([{"grown": pickle.dumps(([vars(t) for t in trees], losses))}])

    return run


class _Places:
    """Tasks of barrier stages that run: a stage starts with all its tasks, so that no more are asked for than run at once."""

    def __init__(self):
        self.free, self.taken = Condition(), 0

    @contextmanager
    def of(self, n: int, most: int) -> Iterator[None]:
        with self.free:
            self.free.wait_for(lambda: self.taken == 0 or self.taken + n <= most)
            self.taken += n
        try:
            yield
        finally:
            with self.free:
                self.taken -= n
                self.free.notify_all()


_places = _Places()


def slots(spark) -> int:
    """Tasks that a barrier stage may have: those that run at once. Where executors come and go, Spark has no such stages."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def grow(rows: DataFrame, values: Sequence[str], flags: Sequence[str], imputed: Sequence[float], label: str, tasks: Callable[[int], int], settings: Settings) -> tuple[list[Tree], list[float]]:
    """Trees learnt from the rows that are not ``_held``, and the log-loss of those that are after each round. Feature numbers are those
    of ``values``, followed by ``flags`` (1 where the value is the ``imputed`` one). ``tasks`` tells by their number over how many tasks
    rows are dealt."""
    spark = rows.sparkSession
    double = lambda names: [F.col(f"`{c}`").cast("double").alias(c) for c in names]
    plain = rows.select(*double(values), *double(flags), F.col(f"`{label}`").cast("double").alias("_label"), F.col("_held").alias("_is_held")).where("_is_held IS NOT NULL")
    surveys = plain.where("NOT _is_held").mapInArrow(_surveys(len(values)), "column int, values binary, counts binary, rows long, missing long, odd long")
    found = surveys.groupBy("column").applyInArrow(_split_columns, "column int, splits array<double>, rows long, missing long, odd long").collect()
    if not found:
        raise ContractError("no rows to learn")
    found.sort(key=lambda r: r["column"])
    if found[0]["odd"]:
        raise ContractError(f"{found[0]['odd']} rows to learn have a label other than 0 and 1")
    splits = [np.array(r["splits"], dtype=float) for r in found]
    layout = Layout(splits, [int(np.searchsorted(s, v, "left")) for s, v in zip(splits, imputed)], [0 < r["missing"] < r["rows"] for r in found])
    most = slots(spark)
    n = min(tasks(found[0]["rows"]), most)
    folder = urlparse(new_path(spark, "boosting"))
    binned = plain.mapInArrow(_binned(layout), "task int, place int, rows int, codes binary, label binary, held binary").repartition(n)
    grown = binned.mapInArrow(_grows(layout, settings, n, folder.path if folder.scheme in ("", "file") else None), "grown binary", barrier=n > 1)
    grown = grown.repartition(1) if n > 1 else grown  # a barrier stage that ends a job is not run again where a task is lost
    with _places.of(n, most):
        (row,) = grown.collect()
    trees, losses = pickle.loads(row["grown"])
    return [Tree(**t) for t in trees], losses
