"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

A pyahocorasick automaton lists every vocabulary piece that ends at a character; dynamic
programming over the ends carries the best score and the number of pieces on the best path. Ties go
as in the tokenizers library's unigram model: among paths to one end the first wins in the order of
their last piece's start, and a later one only by a strictly better score. A character that no
piece covers costs the lowest score less 10, and counts as its UTF-8 bytes under byte fallback, or
else once per run of such characters.

Text is split as its metaspace pre-tokenizer splits it, at every blank, and each distinct word is
counted once per process, up to a bound. A word of any length, such as a text without blanks, takes memory for the places that a
piece can still reach back to.

Results in odd cases: null and empty texts have 0 pieces; a null id is carried through; repeated
rows are counted each; an empty table gives an empty result. Columns besides id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK, UNKNOWN_PENALTY = "▁", 10.0
CHUNK_BYTES, MEMO_WORDS = 8 << 20, 600_000
#: Places of a word that are kept at a time, and characters of the longest word whose count is kept.
KEPT_PLACES, MEMO_CHARS = 1 << 14, 1000


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [
        (sp.id_to_piece(i), sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]


class PieceCounter:
    """Numbers of pieces by a unigram vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, most: int = MEMO_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in vocabulary), default=1)
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback, self.most, self.known = byte_fallback, most, {}

    def count(self, word: str) -> int:
        """Pieces of the best path through ``word``, whose blanks are already replaced."""
        n, base = len(word), 0
        best, pieces, dark = [0.0], [0], [False]  # of the places from ``base`` on
        hits = self.automaton.iter(word)
        hit = next(hits, None)
        for end in range(1, n + 1):
            here = []
            while hit is not None and hit[0] < end:
                here.append(hit[1])
                hit = next(hits, None)
            found, single = None, False
            for length, score in sorted(here, reverse=True) if len(here) > 1 else here:
                start = end - length - base
                single = single or length == 1
                total = score + best[start]
                if found is None or total > found:
                    found, count, unknown = total, pieces[start] + 1, False
            if not single:
                total = self.unknown + best[-1]
                if found is None or total > found:
                    size = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if dark[-1] else 1
                    found, count, unknown = total, pieces[-1] + size, True
            best.append(found)
            pieces.append(count)
            dark.append(unknown)
            if len(best) > KEPT_PLACES and len(best) > 2 * self.longest:  # no piece starts further back than the longest
                gone = len(best) - self.longest
                del best[:gone], pieces[:gone], dark[:gone]
                base += gone
        return pieces[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for word in words:
            if word not in known and len(word) <= MEMO_CHARS:
                known[word] = self.count(BLANK + word)
        return np.fromiter((known[w] if len(w) <= MEMO_CHARS else self.count(BLANK + w) for w in words), np.int64, len(words))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each text."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), BLANK, " ")
        # the first word takes the blank that starts a text, as the pre-tokenizer adds none before it
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        each = self.counts(flat.dictionary.to_pylist())[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return np.diff(upto[offsets])


_counters: dict[str, PieceCounter] = {}


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True
) -> DataFrame:
    """``doc_id, n_pieces`` by the pieces and scores of a sentencepiece model, read as unigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model_path}:{byte_fallback}"
        if key not in _counters:
            _counters[key] = PieceCounter(sentencepiece_vocabulary(model_path), byte_fallback)
        for batch in batches:
            texts = batch.column(1)
            length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff((np.cumsum(length) - length) // CHUNK_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(texts)]):
                n = _counters[key].texts(texts.slice(a, b - a))
                empty = pc.fill_null(pc.equal(pc.binary_length(texts.slice(a, b - a)), 0), True).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.where(empty, 0, n))], names=["doc_id", "n_pieces"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long")
