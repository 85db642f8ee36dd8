"""Best-fit packing of documents into training sequences, as vector bin packing.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed in order of falling length. Among the open sequences whose residual
capacities admit a piece under every constraint, the one with the smallest weighted norm of what
would remain (rule ``norm``) or the largest weighted dot product of residual and demand (rule
``dot``) takes it; if none admits it, a new one opens.

Documents are tokenised and cut where they are read. Pieces, a few numbers each, are dealt
by the place of a row into blocks of about ``block_pieces``; every block is packed by itself, so work and memory
of a task are bounded and a hot source or document spreads over all blocks. A block wastes at
most its last sequences, a fraction of a percent.

Results in odd cases: a null or empty text is its end id alone; only pieces longer than the token
capacity are cut; documents with one id are packed each for itself; a null id is carried through;
an empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.tokens import memo

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with the checksum of their little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo(tokenizer_path)
        for batch in batches:
            for first, ids, lengths in encoder.encode(batch.column(1)):
                sizes = lengths + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                ends = np.cumsum(lengths)
                whole = np.insert(ids, ends, end_id).astype("<u4")
                at = (np.cumsum(sizes) - sizes)[row] + start
                crc = [zlib.crc32(whole[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sizes)).take(pa.array(row)).cast(pa.int64()),
                     pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        encoder.rest()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, PIECES)


def best_fit(
    lengths: np.ndarray,
    capacity: tuple[int, int, int],
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each of ``lengths``, which must fall."""
    n = len(lengths)
    most = np.array(capacity, np.float64)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, 256))  # residual capacities of open sequences
    name, opened, made = np.zeros(256, np.int64), 0, 0
    shortest = int(lengths[-1]) if n else 0
    scale = (np.array(weights) / most**2)[:, None]
    for i, length in enumerate(lengths.tolist()):
        need = np.array([[length], [1], [length * length]], np.float64)
        if (need[:, 0] > most).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacity}")
        rest = left[:, :opened] - need
        fits = (rest >= 0).all(axis=0)
        k = -1
        if fits.any():
            if rule == "norm":
                score = (scale * rest * rest).sum(axis=0)
            elif rule == "dot":
                score = -(scale * left[:, :opened] * need).sum(axis=0)
            else:
                raise ValueError(f"unknown rule {rule!r}")
            k = int(np.where(fits, score, np.inf).argmin())
        if k < 0:
            if opened == left.shape[1]:
                left, name = np.pad(left, ((0, 0), (0, opened))), np.pad(name, (0, opened))
            left[:, opened], name[opened] = most, made
            k, opened, made = opened, opened + 1, made + 1
        bin_of[i], offset[i] = name[k], most[0] - left[0, k]
        left[:, k] -= need[:, 0]
        if left[0, k] < shortest or left[1, k] < 1:  # nothing fits any more
            opened -= 1
            left[:, k], name[k] = left[:, opened], name[opened]
    return bin_of, offset


def pack(
    pieces: DataFrame,
    tokens: int = 2048,
    documents: int = 2048,
    attention: int = 2048 * 2048,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    block_pieces: int = 16384,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; offsets in a sequence have no gaps."""
    blocks = max(1, -(-pieces.count() // block_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offset = best_fit(pdf["length"].to_numpy(), (tokens, documents, attention), weights, rule)
        return pdf.drop(columns="block").assign(
            sequence_id=pdf["block"].to_numpy() * (1 << 31) + bins, offset=offset
        )

    # dealt by the place of a row, so rows that repeat an id, a null one too, spread like any others
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(run, PACKED)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    tokens: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    pieces = stage(cut_pieces(docs, tokenizer_path, end_id, tokens, id_col, text_col), "pieces")
    return pack(pieces, tokens, attention=options.pop("attention", tokens * tokens), **options)
