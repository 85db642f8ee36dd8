"""Fill-in-the-middle: a document is cut in two places and its parts change order behind markers.

Cuts fall between units: words with the white space before them (and trailing white space as one unit), or
characters. Work is on the UTF-8 bytes of a batch. A ``CharIndex`` turns places in bytes into places in
characters and back: it holds the characters of more than one byte only, their places and the bytes that
they add, so spans of ASCII text cost nothing but arithmetic.

A document's cuts and form come from the first four groups of eight digits of the hex SHA-256 of
``seed:id``: two cuts, whether the document is changed at all, and which order it takes:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle
    plain the text as it is: for a share of the documents, empty texts, and texts that hold a marker

A marker can't come about where a part meets a marker, as none starts with the end of another, so ``restored``
finds the exact text from the output and its form alone.

Results in odd cases: a null text is empty, with 0 units and form plain; a null id counts as an empty
one; repeated rows are changed alike, each for itself; a text of any length is one row and costs memory in
proportion to it; an empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat_bytes, parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class CharIndex:
    """Places in characters and in bytes of one stretch of UTF-8, by its characters of several bytes."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)  # lead bytes of characters of two bytes and more
        lead = data[self.at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.extra = np.concatenate([[0], np.cumsum(extra)])
        self.char_at = self.at - self.extra[:-1]

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Characters before each place in bytes, which must be where a character starts, or the end."""
        return places - self.extra[np.searchsorted(self.at, places)]

    def bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before each place in characters."""
        return places + self.extra[np.searchsorted(self.char_at, places)]


def word_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units of words end, in bytes, and the offsets of the texts among these ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    last = np.zeros(len(data) + 1, bool)
    last[at[1:]] = True
    last = last[1:]  # last byte of a text
    ends = np.flatnonzero(last | (~space & np.append(space[1:], True)))
    return ends + 1, np.searchsorted(ends, at)


def _cut(data: np.ndarray, at: np.ndarray, unit: str, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and two cuts of each as places in ``data`` and in characters of the text."""
    index = CharIndex(data)
    start = index.chars(at)
    if unit == "chars":
        n = np.diff(start)
        cuts = np.sort(picks % (n + 1), axis=0) + start[:-1]
        return n, index.bytes(cuts), cuts - start[:-1]
    ends, first = word_ends(data, at)
    n = np.diff(first)
    k = np.sort(picks % (n + 1), axis=0)
    places = np.where(k > 0, np.append(ends, 0)[np.maximum(first[:-1] + k - 1, 0)], at[:-1])
    return n, places, index.chars(places) - start[:-1]


def _rows(ids: pa.Array, texts: pa.Array, keys: np.ndarray, unit: str, rate: int, spm_rate: int) -> pa.RecordBatch:
    data, at = flat_bytes(texts)
    n, cuts, chars = _cut(data, at, unit, keys[:2])
    raw, marks = data.tobytes(), [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    changed, spm = keys[2] % 100 < rate, keys[3] % 100 < spm_rate
    forms, out = [], []
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
        text = raw[a:b]
        if not changed[i] or a == b or any(m in text for m in marks):
            forms.append("plain")
            out.append(text)
            continue
        x, y = int(cuts[0, i]), int(cuts[1, i])
        prefix, suffix, middle = (m + raw[p:q] for m, p, q in zip(marks, (a, y, x), (x, b, y)))
        forms.append("spm" if spm[i] else "psm")
        out.append((suffix + prefix if spm[i] else prefix + suffix) + middle)
    plain = np.array([f == "plain" for f in forms])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n), pa.array(forms), pa.array(chars[0], mask=plain), pa.array(chars[1] - chars[0], mask=plain),
         pa.array(out, pa.binary()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    unit: str = "words",
    rate: int = 50,
    spm_rate: int = 80,
) -> DataFrame:
    """One row per document: ``doc_id, n`` (units), ``form, prefix_chars, middle_chars`` (null if plain), ``output``.

    ``rate`` of 100 documents are changed, and ``spm_rate`` of 100 of these take the order spm. ``unit`` is
    ``words`` or ``chars``.
    """
    if unit not in ("words", "chars"):
        raise ValueError(f"unknown unit: {unit}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[group(k).alias(f"h{k}") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(2 + k).to_numpy() for k in range(4)])
            for a, texts in parts(batch.column(1)):
                yield _rows(batch.column(0).slice(a, len(texts)), texts, keys[:, a : a + len(texts)], unit, rate, spm_rate)

    return rows.mapInArrow(run, RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
