"""Texts of an Arrow batch as flat numpy arrays, a bounded part at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text comes alone.
PART_BYTES = 4 << 20


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, texts)`` for runs of rows of about ``most`` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if a < b:
            yield int(a), texts.slice(a, b - a)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of large strings end to end, and the ``n + 1`` offsets of the texts among them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of large strings, end to end, and the ``n + 1`` offsets of the texts among them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), upto[at].astype(np.int64)
