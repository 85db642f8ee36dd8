"""Repeated windows by distributed prefix doubling over content-defined positions.

Spark sorts rows of (rank, name at the offset), ranks them anew, and positions whose pair is unique leave; then
longer runs are paired. A rank is a pair's place in the sorted order, equal pairs sharing the place of the first. The
rounds, for windows of ``w`` symbols and first names of ``k`` (w = 100 and k = 32, say):

1. ``k`` symbols, at content-defined positions (anchors, see ``windows``). A window lies around one anchor.
2. runs of windows with one anchor (segments): the anchor's rank paired with the names of the first and last window.
   A segment whose pair occurs before is repeated whole; an anchor with one segment content only is done. The first
   segment of each other content goes on for all its copies.
3. ``2 k`` symbols: an anchor's rank paired with the name at the offset ``k`` behind it, and in front of it. A
   window holds one of the two at least, so one whose half is unique is unique.
4. ``w`` symbols: for segments that are still undecided, the rank paired with two names of each window.

Past that length, rows that still meet are repeats; ``later`` ones are removed. Windows and segments are compared by two
independent 64-bit names beside the rank.

Blocks of documents are files in the shared folder. Their segments are found once, when they are written, and kept beside the
text as two small numbers each (windows, and the anchor's place); from then on names are computed only at the places that a round
asks for. A block sends a name once, with the first place where it holds it, so a name that a third of all documents hold is one row a block.
Rows sent and answers are linear in the text: an answer goes back for rows that stay only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, partitions_for, stage
from tidemark.llm.repeats import LOWEST, parts_of, read_block
from tidemark.llm.token_files import _filesystem
from tidemark.llm.tokens import release
from tidemark.llm.windows import mix, named, pair, segments, width, words

#: Bytes of text in a block: a task holds 64-bit names for each.
BLOCK_BYTES = 4 << 20

FILE, TWICE, ANCHOR, RIGHT, LEFT, SEGMENT, WINDOW = range(7)
LATER, MIXED = 1, 2
#: What a block sends: a pair (rank, name), a second name, the first place in the block, and whether it is there twice.
SENT = "kind int, block long, idx int, r long, a long, b long, doc long, at long, again boolean"
ANSWER = "kind int, block long, idx int, flag int, rank long"

#: Bytes of all texts and the end of each text among them.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sent(kind: int, block: int, r, a, b=None, doc=None, at=None, again=None) -> pa.RecordBatch:
    n = len(a)
    zero = np.zeros(n, np.int64)
    long = lambda x: pa.array((zero if x is None else np.ascontiguousarray(x)).view(np.int64), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int32()), long(r), long(a), long(b), long(doc), long(at),
         pa.array(np.zeros(n, bool) if again is None else again)],
        names=["kind", "block", "idx", "r", "a", "b", "doc", "at", "again"],
    )


def answer(kind: np.ndarray, block: np.ndarray, idx: np.ndarray, flag: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(idx, pa.int32()), pa.array(flag, pa.int32()), pa.array(rank, pa.int64())],
        names=["kind", "block", "idx", "flag", "rank"],
    )


COLUMNS = ("kind", "block", "idx", "r", "a", "b", "doc", "at", "again")


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS}


def _joined(x: dict | None, y: dict) -> dict:
    return y if x is None else {c: np.concatenate([x[c], y[c]]) for c in COLUMNS}


def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kind, r, a), those whose pair others have too or that are ``again``, with their rank. The last
    row of a batch waits for the next one; nothing else is held."""
    base = TaskContext.get().partitionId() << 40
    held, held_same, head, place = None, False, 0, 0
    for batch in batches:
        if not len(batch):
            continue
        rows = _joined(held, _arrays(batch))
        n = len(rows["a"])
        same = np.zeros(n + 1, bool)
        same[1:n] = (rows["a"][1:] == rows["a"][:-1]) & (rows["r"][1:] == rows["r"][:-1]) & (rows["kind"][1:] == rows["kind"][:-1])
        same[0] = held_same
        at = place + np.arange(n)
        heads = np.maximum.accumulate(np.where(same[:n], head if n else 0, at))
        keep = (same[:n] | same[1:] | rows["again"])[: n - 1]
        some = np.flatnonzero(keep)
        yield answer(rows["kind"][some], rows["block"][some], rows["idx"][some], np.ones(len(some), np.int64), base + heads[some])
        held, held_same, head, place = {c: x[n - 1 :] for c, x in rows.items()}, bool(same[n - 1]), int(heads[n - 1]), place + n - 1
    if held is not None and (held_same or held["again"][0]):
        yield answer(held["kind"], held["block"], held["idx"], np.ones(1, np.int64), np.array([base + head]))


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kind, r, a, b, doc, at): those behind the first of their pair (``LATER``), and firsts of segments
    whose anchor has several contents (``MIXED``). Held are only the firsts of an anchor's first content. An anchor at an
    end of a range of pairs counts as one with several, as the next range may hold others: that only costs windows."""
    last: dict | None = None  # the row before, as one-element arrays
    lead, several, held = (0, 0), False, None
    for batch in batches:
        if not len(batch):
            continue
        rows = _arrays(batch)
        n = len(rows["a"])
        before = rows if last is None else {c: np.concatenate([last[c], rows[c][:-1]]) for c in COLUMNS}
        start = 1 if last is None else 0
        r_new, c_new = np.ones(n, bool), np.ones(n, bool)
        x = slice(start, n)
        shift = (lambda c: rows[c][:-1]) if last is None else (lambda c: before[c])
        r_new[x] = (rows["r"][x] != shift("r")) | (rows["kind"][x] != shift("kind"))
        c_new[x] = r_new[x] | (rows["a"][x] != shift("a")) | (rows["b"][x] != shift("b"))
        head = np.maximum.accumulate(np.where(c_new, np.arange(n), -1))
        doc0 = np.where(head >= 0, rows["doc"][head], lead[0])
        at0 = np.where(head >= 0, rows["at"][head], lead[1])
        late = (rows["doc"] > doc0) | ((rows["doc"] == doc0) & (rows["at"] > at0))
        group = np.cumsum(r_new) - (1 if r_new[0] else 0)  # 0: the anchor of this batch's first row
        extra = c_new & ~r_new
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[extra]] = True
        mixed[0] |= last is None  # the range before may hold more of the first anchor
        if not r_new[0]:
            mixed[0] |= several
            if held is not None and (mixed[0] or group[-1] > 0):
                if mixed[0]:
                    yield answer(held["kind"], held["block"], held["idx"], np.full(len(held["a"]), MIXED), held["r"])
                held = None
        else:
            held = None
        first = (rows["kind"] == SEGMENT) & ~late
        flags = np.where(late, LATER, np.where(first & mixed[group], MIXED, 0))
        some = np.flatnonzero(flags)
        yield answer(rows["kind"][some], rows["block"][some], rows["idx"][some], flags[some], rows["r"][some])
        several = bool(mixed[-1])
        if not several:
            wait = np.flatnonzero(first & (group == group[-1]))
            if len(wait):
                held = _joined(held, {c: v[wait] for c, v in rows.items()})
        last = {c: v[n - 1 :] for c, v in rows.items()}
        lead = (int(doc0[n - 1]), int(at0[n - 1]))
    if held is not None:  # the range behind may hold more of the last anchor
        yield answer(held["kind"], held["block"], held["idx"], np.full(len(held["a"]), MIXED), held["r"])


class Answers:
    """What a block has been told, by kind."""

    def __init__(self, table: pa.Table):
        self.kind = table["kind"].to_numpy()
        self.idx, self.flag, self.rank = (table[c].to_numpy() for c in ("idx", "flag", "rank"))

    def marked(self, kind: int, n: int, flag: int = LATER) -> np.ndarray:
        out = np.zeros(n, bool)
        out[self.idx[(self.kind == kind) & (self.flag == flag)]] = True
        return out

    def ranks(self, n: int) -> np.ndarray:
        """Rank of each of the block's anchors, -1 for those that have left."""
        out = np.full(n, -1, np.int64)
        mine = self.kind == ANCHOR
        out[self.idx[mine]] = self.rank[mine]
        return out


class Firsts:
    """The first of equal (a, b) in a block by ``when``, and each entry's relation to it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, when: np.ndarray):
        self.first, self.group, self.later = np.zeros(0, np.int64), np.empty(len(a), np.int64), np.zeros(len(a), bool)
        if not len(a):
            return
        order = np.argsort(a)
        new, other = self._changes(a, order), self._changes(b, order)
        if (other & ~new).any():  # names that differ in b only
            order = np.lexsort((b, a))
            new = self._changes(a, order) | self._changes(b, order)
        number, sorted_when = np.cumsum(new) - 1, when[order]
        leads = sorted_when == np.minimum.reduceat(sorted_when, np.flatnonzero(new))[number]
        some = np.flatnonzero(leads)
        self.first = order[some[self._changes(number, some)]]
        self.group[order] = number
        self.later[order] = ~leads

    @staticmethod
    def _changes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Where ``x`` in ``order`` differs from the entry before."""
        x, out = x[order], np.ones(len(order), bool)
        out[1:] = x[1:] != x[:-1]
        return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry of each key, whether the key is there twice, and each entry's key number."""
    _, first, number, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, times > 1, number


def kept_segments(data: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[pa.Array, pa.Array]:
    """For each document, of its segments in order, the number of windows, and the anchor's place behind the first of them.
    The segments of a document follow each other without a gap."""
    small, n = np.min_scalar_type(w), width(k)
    counts, sizes, places = np.zeros(len(ends), np.int64), [np.zeros(0, small)], [np.zeros(0, small)]
    for doc, until, a, b in parts_of(ends, w):
        local = np.minimum(ends[doc:until], b) - a
        found = segments(mix(words(data[a:b], n)), local, k, w, n)
        counts[doc:until] += np.bincount(np.searchsorted(local, found["first"], side="right"), minlength=until - doc)
        sizes.append((found["last"] - found["first"] + 1).astype(small))
        places.append((found["place"] - found["first"]).astype(small))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (sizes, places))


class Block:
    """What a block computes from its text, as far as the answers that it has allow."""

    def __init__(self, table: pa.Table, symbols: Symbols, k: int, w: int):
        self.k, self.w = k, w
        self.data, self.ends = symbols(table["text"].combine_chunks())
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.table = table
        self.width = width(k)
        self.numbers = words(self.data, self.width)
        # all segments: their document, first and last window, and anchor's place
        counts = pc.list_value_length(table["windows"]).to_numpy().astype(np.int64)
        n, place = (pc.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("windows", "place"))
        self.row = np.repeat(np.arange(len(counts)), counts)
        before = np.cumsum(n) - n
        heads = np.cumsum(counts) - counts
        skipped = np.append(before, 0)[heads]  # windows of the documents before
        self.first = self.starts[self.row] + before - skipped[self.row] if len(n) else n
        self.last, self.place = self.first + n - 1, self.first + place

    def named(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        return named(self.numbers, self.width, at, length, seed)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the block's anchors, whether each is there twice, and the number of each segment's."""
        keys, number, times = np.unique(self.named(self.place, self.k), return_inverse=True, return_counts=True)
        return keys, times > 1, number

    def segments(self, known: Answers) -> None:
        """Segments of the anchors that have stayed, with the names of their ends."""
        self.doc_of = pc.fill_null(self.table["doc_id"], LOWEST).to_numpy()
        self.again = np.zeros(len(self.doc_of), np.int64)
        for i in np.flatnonzero(known.marked(TWICE, len(self.again))):  # only rows that repeat an id need an order among them
            self.again[i] = zlib.crc32(np.ascontiguousarray(self.data[self.starts[i] : self.ends[i]])) >> 1 << 31
        order = np.lexsort((self.again, self.doc_of))
        new = np.ones(len(order), bool)
        new[1:] = (self.doc_of[order][1:] != self.doc_of[order][:-1]) | (self.again[order][1:] != self.again[order][:-1])
        self.turn = np.empty(len(order), np.int64)  # of rows by (document, order), equal ones sharing theirs
        self.turn[order] = np.cumsum(new) << 31
        keys, _, number = self.anchors()
        ranks = known.ranks(len(keys))[number]
        some = np.flatnonzero(ranks >= 0)
        self.rank, self.place, self.first, self.last, self.row = ranks[some], self.place[some], self.first[some], self.last[some], self.row[some]
        n = (self.last - self.first).astype(np.uint64)
        self.content, self.other = (pair(pair(self.named(self.first, self.w, seed), self.named(self.last, self.w, seed)), n) for seed in (0, 1))
        self.at = self.again[self.row] + self.first - self.starts[self.row]
        self.classes = Firsts(self.content, self.other, self.turn[self.row] + self.first - self.starts[self.row])

    def first_round(self, block: int) -> Iterator[pa.RecordBatch]:
        keys, again, _ = self.anchors()
        yield sent(ANCHOR, block, None, keys, again=again)

    def second_round(self, block: int) -> Iterator[pa.RecordBatch]:
        lead = self.classes.first
        yield sent(SEGMENT, block, self.rank[lead], self.content[lead], self.other[lead], self.doc_of[self.row[lead]], self.at[lead])

    def undecided(self, known: Answers) -> None:
        """Segments that are the first of their content in the corpus, where their anchor has others; and their halves: windows
        hold the right one from 2k - w before the anchor on, the left one up to k before it."""
        m, k, w = len(self.classes.first), self.k, self.w
        gone = known.marked(SEGMENT, m)
        self.whole = self.classes.later | gone[self.classes.group] if m else self.classes.later
        self.open = self.classes.first[known.marked(SEGMENT, m, MIXED) & ~gone]
        right = self.open[self.last[self.open] >= self.place[self.open] + 2 * k - w]
        left = self.open[self.first[self.open] <= self.place[self.open] - k]
        rank = self.rank.view(np.uint64)
        names = {RIGHT: pair(rank[right] + np.uint64(1), self.named(self.place[right] + k, k)), LEFT: pair(self.named(self.place[left] - k, k), rank[left] + np.uint64(2))}
        self.halves = [(kind, at, names[kind], distinct(names[kind])) for kind, at in ((RIGHT, right), (LEFT, left))]

    def third_round(self, block: int) -> Iterator[pa.RecordBatch]:
        for kind, at, names, (first, again, _) in self.halves:
            yield sent(kind, block, self.rank[at[first]], names[first], again=again)

    def windows(self, known: Answers) -> None:
        """Single windows of segments that are neither repeated nor alone with their anchor, if their half recurs."""
        k, w = self.k, self.w
        open_ = np.zeros(len(self.rank), bool)
        open_[self.open] = True
        recurs = {}
        for kind, at, _, (first, _, number) in self.halves:
            recurs[kind] = np.zeros(len(self.rank), bool)
            recurs[kind][at] = known.marked(kind, len(first))[number] if len(at) else False
        # windows that start in [lowest, highest): without a recurring left half none up to k before the anchor, without a right one none later
        order = np.flatnonzero(open_ & (recurs[RIGHT] | recurs[LEFT]))
        order = order[np.argsort(self.first[order], kind="stable")]
        low = np.where(recurs[LEFT][order], self.first[order], np.maximum(self.first[order], self.place[order] - k + 1))
        high = np.where(recurs[RIGHT][order], self.last[order] + 1, np.minimum(self.last[order] + 1, self.place[order] + 2 * k - w))
        n = np.maximum(high - low, 0)
        which = np.repeat(order, n)
        self.window = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.window_row = self.row[which]
        offset = self.window - self.starts[self.window_row]
        self.window_at = self.again[self.window_row] + offset
        self.one, self.two = pair(self.rank[which].view(np.uint64), self.named(self.window, w)), self.named(self.window, w, 1)
        self.singles = Firsts(self.one, self.two, self.turn[self.window_row] + offset)

    def fourth_round(self, block: int) -> Iterator[pa.RecordBatch]:
        lead = self.singles.first
        yield sent(WINDOW, block, None, self.one[lead], self.two[lead], self.doc_of[self.window_row[lead]], self.window_at[lead])

    def removed(self, known: Answers) -> np.ndarray:
        """Which symbols repeated windows cover."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        gone = known.marked(WINDOW, len(self.singles.first))
        single = self.window[self.singles.later | gone[self.singles.group]] if len(self.window) else self.window
        begin = np.concatenate([self.first[self.whole], single])
        n = np.concatenate([(self.last - self.first + 1)[self.whole], np.ones(len(single), np.int64)])
        opened = np.bincount(begin, minlength=total + 1)
        closed = np.bincount(begin + n + self.w - 1, minlength=total + 1)
        return np.cumsum(opened - closed)[:-1] > 0


def remove(
    docs: DataFrame, symbols: Symbols, k: int, w: int, id_col: str, text_col: str,
    finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, range_bytes: int = 32 << 20, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``finish(block's documents, which symbols are repeated)`` for every block."""
    if not w >= 2 * k + 1 or w > 3 * k + 4:
        raise ValueError("a window must hold a pair of runs on one side of its anchor: 2 k < w <= 3 k + 4")
    folder = new_path(docs.sparkSession, "blocks")
    parts = partitions_for(docs, text_col, range_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block files, and a row for each document: the block's number, its file's name and the id."""
        filesystem, at = _filesystem(folder)
        filesystem.create_dir(at, recursive=True)
        options, number = pa.ipc.IpcWriteOptions(compression="zstd"), TaskContext.get().partitionId() << 20
        for batch in batches:
            table = pa.table({"doc_id": batch.column(0), "text": batch.column(1).cast(pa.large_string())})
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // block_bytes)) + 1).tolist(), len(table)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    piece, file = table.slice(a, b - a).combine_chunks(), uuid.uuid4().int >> 66
                    for name, column in zip(("windows", "place"), kept_segments(*symbols(piece["text"].combine_chunks()), k, w)):
                        piece = piece.append_column(name, column)
                    with filesystem.open_output_stream(f"{at}/{file:016x}.arrow") as out:
                        with pa.ipc.new_file(out, piece.schema, options=options) as writer:
                            writer.write_table(piece)
                    n = b - a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number), pa.int64()), pa.array(np.full(n, file), pa.int64()), pa.array(np.arange(n), pa.int32()), piece["doc_id"].combine_chunks()],
                        names=["block", "file", "idx", "doc"],
                    )
                    number += 1

    def in_blocks(answers: DataFrame, work: Callable[[int, Block, pa.Table, Answers], pa.Table], out: str) -> DataFrame:
        def run(group: pa.Table) -> pa.Table:
            block, known = group["block"][0].as_py(), Answers(group)
            table = read_block(folder, int(known.rank[known.kind == FILE][0]))
            state = Block(table, symbols, k, w)
            got = work(block, state, table, known)
            del state, table
            release()
            return got

        return answers.repartition(2 * blocks, "block").groupBy("block").applyInArrow(run, out)

    def first(block: int, state: Block, table: pa.Table, known: Answers) -> pa.Table:
        return pa.Table.from_batches(state.first_round(block))

    def second(block: int, state: Block, table: pa.Table, known: Answers) -> pa.Table:
        state.segments(known)
        return pa.Table.from_batches(state.second_round(block))

    def third(block: int, state: Block, table: pa.Table, known: Answers) -> pa.Table:
        state.segments(known)
        state.undecided(known)
        return pa.Table.from_batches(state.third_round(block))

    def fourth(block: int, state: Block, table: pa.Table, known: Answers) -> pa.Table:
        state.segments(known)
        state.undecided(known)
        state.windows(known)
        return pa.Table.from_batches(state.fourth_round(block))

    def last(block: int, state: Block, table: pa.Table, known: Answers) -> pa.Table:
        state.segments(known)
        state.undecided(known)
        state.windows(known)
        return finish(table, state.removed(known))

    def ranked(rows: DataFrame, order: list[str], work, name: str, by: list[str] | None = None) -> DataFrame:
        """Rows sorted by their pair and answered in that order. Names are uniform, so ranges of them are cut by their first
        bits; pairs ``by`` a rank are cut into ranges by Spark's sampling."""
        if by:
            dealt = rows.repartitionByRange(parts, *by)
        else:
            bits = F.shiftrightunsigned("a", 40).cast("long") * parts
            dealt = rows.repartitionById(parts, F.shiftright(bits, 24).cast("int"))
        return stage(dealt.sortWithinPartitions(*order).mapInArrow(work, ANSWER), name)

    named = stage(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(write, "block long, file long, idx int, doc long"), "block-files")
    files = named.groupBy("block").agg(F.first("file").alias("rank")).select(F.lit(FILE).alias("kind"), "block", F.lit(0).alias("idx"), F.lit(0).alias("flag"), "rank")
    ids = named.groupBy(F.col("doc").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = named.join(ids, F.col("doc").eqNullSafe(F.col("d")), "left_semi").select(F.lit(TWICE).alias("kind"), "block", "idx", F.lit(LATER).alias("flag"), F.lit(0).cast("long").alias("rank"))
    known = stage(files.unionByName(twice), "block-marks")
    blocks = max(1, known.where(F.col("kind") == FILE).count())
    pair_order, place_order = ["kind", "r", "a"], ["kind", "r", "a", "b", "doc", "at"]
    known = known.unionByName(ranked(in_blocks(known, first, SENT), pair_order, recurring, "ranks"))
    rows = stage(in_blocks(known, second, SENT), "pairs")
    known = known.unionByName(ranked(rows, place_order, judged, "segments", ["r", "a"]))
    known = known.unionByName(ranked(in_blocks(known, third, SENT), pair_order, recurring, "halves"))
    known = known.unionByName(ranked(in_blocks(known, fourth, SENT), place_order, judged, "repeats"))
    return in_blocks(known, last, schema)
