"""Windows of symbols that occur before: the part that substring dedup and suffix-array dedup share.

Documents are written once, in blocks of bounded size, to compressed files in the shared folder;
later steps bring rows of numbers to the blocks and never move text again. The steps:

1. ``write_blocks``: block files, and the names of the segment anchors of every block.
2. ``recurring``: anchors that occur more than once in the corpus. An anchor that does not is
   unique, and so are all its windows.
3. ``locate``: segments of recurring anchors, by a function of the caller on one block.
4. ``classes``: segments with the same windows form a class; the first occurrence of a class
   decides for all its copies at once. Only where an anchor has several classes are single
   windows compared, one occurrence of each class.
5. ``windows_of``: names of those windows from the blocks; the first occurrence of each name.
6. ``covered``: what to remove, as runs of windows by document row.

Names are 64-bit hashes; segments and windows are compared by two of them. A row's order among
rows of one document id is that of a checksum of its text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, salted_join, stage
from tidemark.llm.token_files import _filesystem
from tidemark.llm.windows import grown, segments

#: Bytes of text in a block, and symbols that are hashed at once.
BLOCK_BYTES, PART_SYMBOLS = 8 << 20, 1 << 18

LOWEST = -(1 << 63)
SEGMENTS = "block long, row int, anchor long, h0 long, h1 long, n int, doc long, at long"
WINDOWS = "block long, row int, h0 long, h1 long, doc long, at long"

#: Symbols of a block: (names of all symbols, end of each document among them).
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def read_block(folder: str, block: int) -> pa.Table:
    filesystem, at = _filesystem(folder)
    with filesystem.open_input_file(f"{at}/{block:016x}.arrow") as file:
        return pa.ipc.open_file(file).read_all()


def parts_of(ends: np.ndarray, w: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first doc, last doc, first symbol, last symbol)`` of parts of about PART_SYMBOLS symbols;
    a long document makes parts of its own that overlap by a window."""
    begin, doc = 0, 0
    starts = np.concatenate([[0], ends[:-1]])
    while doc < len(ends):
        until = max(doc + 1, int(np.searchsorted(ends, starts[doc] + PART_SYMBOLS, side="right")))
        a, b = int(starts[doc]), int(ends[until - 1])
        if b - a <= 2 * PART_SYMBOLS:
            yield doc, until, a, b
        else:
            for begin in range(a, max(a + 1, b - w + 1), PART_SYMBOLS):
                yield doc, until, begin, min(b, begin + PART_SYMBOLS + w - 1)
        doc = until


def scan(names: np.ndarray, ends: np.ndarray, k: int, w: int) -> Iterator[tuple[int, int, dict]]:
    """``(first doc, first symbol, segments)`` of each part; ``segments`` has ``doc`` as well."""
    for doc, until, a, b in parts_of(ends, w):
        local = np.minimum(ends[doc:until], b) - a
        found = segments(names[a:b], local, k, w)
        found["doc"] = doc + np.searchsorted(local, found["first"], side="right")
        yield doc, a, found


def write_blocks(
    docs: DataFrame, symbols: Symbols, k: int, w: int, id_col: str, text_col: str
) -> tuple[str, DataFrame]:
    """Folder of the block files, and rows ``block, anchors`` (packed names, each once)."""
    folder = new_path(docs.sparkSession, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, at = _filesystem(folder)
        filesystem.create_dir(at, recursive=True)
        for batch in batches:
            table = pa.table({"doc_id": batch.column(0), "text": batch.column(1).cast(pa.large_string())})
            size = np.cumsum(np.array(pc.fill_null(pc.binary_length(table["text"]), 0)))
            part = size // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(table)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                piece, block = table.slice(a, b - a).combine_chunks(), uuid.uuid4().int >> 66
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                with filesystem.open_output_stream(f"{at}/{block:016x}.arrow") as out:
                    with pa.ipc.new_file(out, piece.schema, options=options) as writer:
                        writer.write_table(piece)
                names, ends = symbols(piece["text"].combine_chunks())
                found = [s["anchor"] for _, _, s in scan(names, ends, k, w)]
                anchors, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(anchors)], pa.int32()), pa.array(anchors.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array([0, len(anchors)], pa.int32()), pa.array(times > 1))],
                    names=["block", "anchors", "again"],
                )

    made = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "block long, anchors array<long>, again array<boolean>"
    )
    return folder, stage(made, "block-anchors")


def recurring(blocks: DataFrame) -> DataFrame:
    """``block, anchor, times, home, blocks`` for the anchors of each block that occur anywhere else, or twice here;
    ``home`` is the block that speaks for the anchor, ``blocks`` the number that have it. A block has an anchor once, however
    often it holds it. Anchors are counted map-side, and blocks find their counts by a join that deals out anchors of very many
    blocks, so no task holds all blocks of one."""
    each = blocks.select("block", F.explode(F.arrays_zip("anchors", "again")).alias("x"))
    each = each.select("block", F.col("x.anchors").alias("anchor"), F.col("x.again").cast("int").alias("again"))
    counts = each.groupBy("anchor").agg(F.sum(F.lit(1) + F.col("again")).alias("times"), F.min("block").alias("home"), F.count(F.lit(1)).alias("blocks"))
    counts = stage(counts.where("times > 1"), "anchor-counts")
    return salted_join(each.select("block", "anchor"), counts, ["anchor"], "blocks", ["block"])


def by_block(blocks: DataFrame, rows: DataFrame, folder: str, work, columns: list[str], schema: str) -> DataFrame:
    """``work(block, table of the block, rows of the block)`` for every block.

    ``rows`` come with ``block``; each block also gets one row of nulls, so that none is left out.
    """
    marks = blocks.select("block", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns])
    both = rows.select("block", *columns).unionByName(marks)

    def run(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        mine = group.filter(pc.is_valid(group[columns[0]]))
        return work(block, read_block(folder, block), mine)

    return both.groupBy("block").applyInArrow(run, schema)


def order_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Document id of each row (the lowest number for null), and its order among rows of that id."""
    doc = pc.fill_null(table["doc_id"], LOWEST).to_numpy()
    text = table["text"].to_pylist()
    again = np.array([zlib.crc32((t or "").encode()) >> 1 for t in text], np.int64) << 31
    return doc, again


def segment_table(block: int, table: pa.Table, names: np.ndarray, ends: np.ndarray, k: int, w: int, wanted) -> pa.Table:
    """SEGMENTS rows of the segments that ``wanted(first symbol, segments)`` marks."""
    doc_of, again = order_of(table)
    starts = np.concatenate([[0], ends[:-1]])
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for _, a, s in scan(names, ends, k, w):
        keep = np.flatnonzero(wanted(a, s))
        if not len(keep):
            continue
        win = grown(s["runs"], k, w)
        first, last, row = s["first"][keep], s["last"][keep], s["doc"][keep]
        at = again[row] + (first + a - starts[row])
        for column, x in zip(out, (row, s["anchor"][keep], win[first], win[last], last - first + 1, doc_of[row], at)):
            column.append(x)
    cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    view = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x
    return pa.table(
        [pa.array(np.full(len(cat[0]), block), pa.int64()), pa.array(cat[0], pa.int32()), *[pa.array(view(x), pa.int64()) for x in cat[1:4]],
         pa.array(cat[4], pa.int32()), pa.array(cat[5], pa.int64()), pa.array(cat[6], pa.int64())],
        names=["block", "row", "anchor", "h0", "h1", "n", "doc", "at"],
    )


def first_of(rows: DataFrame, keys: list[str], same_doc: bool) -> DataFrame:
    """``doc0`` and, if places within a document count, ``at0``: the first place of each key, by
    document and then place, and ``size``, its rows. Combines map-side."""
    size = F.count(F.lit(1)).alias("size")
    if not same_doc:
        return rows.groupBy(*keys).agg(F.min("doc").alias("doc0"), size)
    return (
        rows.groupBy(*keys, "doc").agg(F.min("at").alias("at"), size)
        .groupBy(*keys).agg(F.min("doc").alias("doc0"), F.min_by("at", "doc").alias("at0"), F.sum("size").alias("size"))
    )


def covered(blocks: DataFrame, located: DataFrame, folder: str, symbols: Symbols, k: int, w: int, same_doc: bool) -> DataFrame:
    """``block, row, at, n``: runs of windows whose content also starts before.

    ``same_doc``: an earlier place in the same document counts, not only one in a document of a
    smaller id.
    """
    key = ["anchor", "h0", "h1", "n"]
    classes = first_of(located, key, same_doc)
    kinds = stage(classes, "classes")
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    earlier = F.col("doc") > F.col("doc0")
    if same_doc:
        earlier = earlier | ((F.col("doc") == F.col("doc0")) & (F.col("at") > F.col("at0")))
    classes = stage(kinds.join(mixed, "anchor", "left"), "kinds")
    judged = salted_join(located, classes, key, "size", ["block", "row", "at"]).select("block", "row", "at", "n", earlier.alias("gone"), "kinds")
    judged = stage(judged.where("gone OR kinds IS NOT NULL").drop("kinds"), "judged")
    whole = judged.where("gone").drop("gone")
    open_ = judged.where("NOT gone").drop("gone")

    def windows(block: int, table: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("at", "ascending")])
        row, at, n = (rows[c].to_numpy() for c in ("row", "at", "n"))
        doc_of, again = order_of(table)
        names, ends = symbols(table["text"].combine_chunks())
        starts = np.concatenate([[0], ends[:-1]])
        begin = starts[row] + (at - again[row])
        order = np.argsort(begin, kind="stable")
        begin, n, row = begin[order], n[order].astype(np.int64), row[order]
        out = [], [], [], []
        for _, _, a, b in parts_of(ends, w):
            lo, hi = np.searchsorted(begin, [a, b - w + 1])
            if lo >= hi:
                continue
            half = grown(names[a:b], 1, (w + 1) // 2)
            shift = w - (w + 1) // 2
            place = np.repeat(begin[lo:hi] - np.cumsum(n[lo:hi]) + n[lo:hi], n[lo:hi]) + np.arange(n[lo:hi].sum()) - a
            which = np.repeat(row[lo:hi], n[lo:hi])
            inside = place + w <= b - a
            place, which = place[inside], which[inside]
            out[0].append(which)
            out[1].append(half[place])
            out[2].append(half[place + shift])
            out[3].append(again[which] + place + a - starts[which])
        row, h0, h1, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        view = lambda x: pa.array(x.view(np.int64), pa.int64())
        return pa.table(
            [pa.array(np.full(len(row), block), pa.int64()), pa.array(row, pa.int32()), view(h0), view(h1),
             pa.array(doc_of[row] if len(row) else [], pa.int64()), pa.array(at, pa.int64())],
            names=["block", "row", "h0", "h1", "doc", "at"],
        )

    pairs = stage(by_block(blocks, open_, folder, windows, ["row", "at", "n"], WINDOWS), "windows")
    firsts = stage(first_of(pairs, ["h0", "h1"], same_doc), "window-firsts")
    single = salted_join(pairs, firsts, ["h0", "h1"], "size", ["block", "row", "at"]).where(earlier)
    return stage(whole.unionByName(single.select("block", "row", "at", F.lit(1).alias("n"))), "covered")


def mask_of(ends: np.ndarray, again: np.ndarray, rows: pa.Table, w: int) -> np.ndarray:
    """Which symbols of a block the runs of windows in ``rows`` cover."""
    starts = np.concatenate([[0], ends[:-1]])
    total = int(ends[-1]) if len(ends) else 0
    row, at, n = (rows[c].to_numpy() for c in ("row", "at", "n"))
    begin = starts[row] + (at - again[row])
    opened = np.bincount(begin, minlength=total + 1)
    closed = np.bincount(begin + n + w - 1, minlength=total + 1)
    return np.cumsum(opened - closed)[:-1] > 0
