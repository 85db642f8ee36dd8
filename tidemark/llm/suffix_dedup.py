"""Byte-level substring dedup by distributed prefix doubling.

Prefix doubling ranks suffixes by their first 1, 2, 4, ... symbols: the rank at twice the length
is the rank of the pair of ranks at an offset. Here the pairs up to ``seed`` bytes are named where
the text is read, at content-defined positions (see ``windows``). From there on Spark sorts the pairs of every
round, at 32, 64 and 100 bytes: equal pairs share a rank, positions with a unique pair leave, and the others
go on at the next offset (see ``doubling``). Past ``length`` bytes, ranks that still meet are repeats. No suffix
array is ever held in one place.

Results in odd cases: a null text counts as empty; texts shorter than ``length`` lose nothing; a
null id counts as smaller than any other; rows that repeat an id are ordered by a checksum of
their text, and rows that repeat id and text are the same document and do not remove each other;
an empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import doubling

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the end of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def remove_repeated(
    docs: DataFrame, length: int = 100, seed: int = 32, id_col: str = "doc_id", text_col: str = "text", **sizes: int
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256``; ``sizes`` as for ``doubling.remove``."""

    def finish(table: pa.Table, gone: np.ndarray) -> pa.Table:
        data, ends = _bytes(table["text"].combine_chunks())
        starts = np.concatenate([[0], ends[:-1]])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = starts[starts < len(gone)]
        opens[heads] = gone[heads]  # a run never crosses documents
        spans = np.concatenate([[0], np.cumsum(opens)])[np.concatenate([[0], ends])]
        left = np.concatenate([[0], np.cumsum(~gone)])[np.concatenate([[0], ends])]
        rest = data[~gone].tobytes()
        kept = [rest[a:b] for a, b in zip(left.tolist(), left[1:].tolist())]
        n = ends - starts
        return pa.table(
            [table["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array(np.diff(spans), pa.int64()),
             pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )

    return doubling.remove(docs, _bytes, seed, length, id_col, text_col, finish, RESULT, **sizes)
