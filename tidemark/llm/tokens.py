"""Exact token ids of whole texts, encoding each distinct word once.

The vocabulary file's pre-tokenizer drops white space and never joins across it, so the ids of
a text are the ids of its white-space separated words in turn. ``WordMemo`` keeps the ids of
words that the process has met, up to a bound, and gathers ids of a batch with numpy. Words that recur
stay from task to task.

Two steps make words meet more often and change no id. Words of ASCII are lowered, as the vocabulary's normaliser does, but
for those with ``<|``, which may spell a special token in exact case. And a word of ASCII letters with ASCII
punctuation behind it is cut between the two: its pre-tokenizer cuts there as well, and nothing composes across the cut. The
apostrophe doesn't count as such punctuation, since it may start a contraction.
"""

from __future__ import annotations

import os
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time, words kept per process, and new words encoded in one call.
CHUNK_BYTES, MEMO_WORDS, CALL_WORDS = 4 << 20, 300_000, 8192
#: Letters, and punctuation that may be cut off behind them.
LETTERS = string.ascii_letters
PUNCTUATION = string.punctuation.replace("'", "")


def release() -> None:
    """Give back what a finished task has freed: Python workers stay, idle, beside their executor."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


_memos: dict[tuple[str, int], WordMemo] = {}


def take(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` at ``starts``, end to end."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(n) + np.repeat(starts - (ends - lengths), lengths)], lengths


class WordMemo:
    """Ids of texts by the tokenizers library, word by word."""

    def __init__(self, path: str, most: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words that at least two chunks had, the more frequent ones if those are over half of the bound."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > (half := self.most // 2):
            keep = np.sort(keep[np.argpartition(-self.met[keep], half)[:half]])
        words = list(self.known)
        self.ids, size = take(self.ids, self.starts[keep], np.diff(self.starts)[keep])
        self.starts = np.concatenate([[0], np.cumsum(size)])
        self.known = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.met = np.maximum(self.met[keep] // 2, 1)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has. Words go through in one call; the
        place of a token in the joined text tells its word."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - (size + 1)
        place = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(got.ids))[::2]
        word = np.searchsorted(start, place, side="right") - 1
        return np.array(got.ids, np.uint32), np.bincount(word, minlength=len(words))

    def _rows(self, words: list[str]) -> np.ndarray:
        """Row of each word among ``starts``; new ones are encoded. Hardly any stands twice."""
        if len(self.known) + len(words) > self.most and self.known:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            # the library holds about 100 bytes a token of a call: its size is what bounds them
            parts = [self._encode(new[a : a + CALL_WORDS]) for a in range(0, len(new), CALL_WORDS)]
            ids, each = (np.concatenate(p) for p in zip(*parts))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(each)])
            self.ids = np.concatenate([self.ids, ids])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.met[rows] += 1
        return rows

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, where those of each start, and how many it has."""
        plain = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<|"))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        core = pc.ascii_rtrim(words, PUNCTUATION)
        cut = pc.and_(plain, pc.ascii_is_alpha(core))
        core = pc.if_else(cut, core, words).dictionary_encode()
        tail = pc.if_else(cut, pc.ascii_ltrim(words, LETTERS), "").dictionary_encode()
        rows = self._rows(core.dictionary.to_pylist() + tail.dictionary.to_pylist())
        n = len(core.dictionary)
        at = np.stack([rows[:n][core.indices.to_numpy()], rows[n:][tail.indices.to_numpy()]], 1).ravel()
        ids, size = take(self.ids, self.starts[at], self.starts[at + 1] - self.starts[at])
        size = size[::2] + size[1::2]
        return ids, np.cumsum(size) - size, size

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        ids, starts, size = self._words(flat.dictionary)
        word = flat.indices.to_numpy()
        ids, length = take(ids, starts[word], size[word])
        per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(per)]).astype(np.int64)]
        return ids, np.diff(upto)

    def encode(self, texts: pa.Array):
        """Yield ``(first row, ids, ids per row)`` for runs of rows of a string array; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // CHUNK_BYTES
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            if a < b:
                yield a, *self._chunk(texts.slice(a, b - a))

    def rest(self) -> None:
        """At a task's end: forget the words that one chunk had, and give the memory back."""
        self._forget()
        release()


def memo(path: str, most: int = MEMO_WORDS) -> WordMemo:
    """The process's memo for a vocabulary file."""
    if (path, most) not in _memos:
        _memos[path, most] = WordMemo(path, most)
    return _memos[path, most]
