"""Substring dedup by repeated-phrase automata.

Every 50-word window holds a content-defined phrase (its anchor). Phrases that occur again anywhere in the
corpus are confirmed by counting, and one block speaks for each: it spells its words, the only thing that is
matched from there on. The confirmed phrases are dealt into shards, each with the phrases that may occur
in one block of documents; a shard's phrases are compiled into a pyahocorasick automaton over word
numbers, through which all documents of the block are streamed to locate every occurrence, word for word. So
all documents pass an automaton of every phrase that they may hold, and the work grows with the corpus; every document
through every shard would be quadratic. Only located occurrences go on: runs of windows around them are
compared across documents (see ``repeats``), and every word that a window repeated from a document of a
smaller id covers is removed.

Results in odd cases: a null text has no words; texts of fewer words than the window lose none;
a null id counts as smaller than any other; rows that repeat an id never remove each other's
words; an empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.repeats import SEGMENTS, by_block, covered, mask_of, order_of, recurring, segment_table, write_blocks
from tidemark.llm.common import salted_join, stage
from tidemark.llm.tokens import release
from tidemark.llm.windows import grown

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts, dictionary-coded, and the end of each text among them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(some)])
    ends = upto[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
    return flat.filter(pa.array(some)).dictionary_encode(), ends


def names_of(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit names of coded words."""
    from xxhash import xxh3_64_intdigest

    names = np.fromiter(map(xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return names[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, ends = words_of(texts)
    return names_of(words), ends


#: Symbols that one place of a word's code may take. A node of the automaton searches its branches in
#: turn, so words are spelt in few symbols rather than being one of very many.
BASE = 128


def spelt(numbers: np.ndarray, places: int) -> str:
    """Word numbers as text: ``places`` characters each, from an alphabet of their own per place."""
    digits = np.stack([numbers // BASE**i % BASE + BASE * i for i in range(places)], axis=1)
    return digits.astype("<u4").tobytes().decode("utf-32-le")


def phrase_hits(numbers: np.ndarray, ends: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and phrase number of every occurrence of ``phrases`` (rows of word numbers) in documents."""
    import ahocorasick

    top = int(max(numbers.max(initial=0), phrases.max(initial=0)))
    places = 1
    while BASE**places <= top:
        places += 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    width = phrases.shape[1] * places
    text = spelt(phrases.ravel(), places)
    for i in range(len(phrases)):
        automaton.add_word(text[i * width : (i + 1) * width], i)
    automaton.make_automaton()
    at, which, begin = [], [], 0
    for end in ends.tolist():
        if end - begin >= phrases.shape[1]:
            for last, i in automaton.iter(spelt(numbers[begin:end], places)):
                at.append(begin + (last + 1 - width) // places)
                which.append(i)
        begin = end
    return np.array(at, np.int64), np.array(which, np.int64)


def remove_repeated(
    docs: DataFrame, words: int = 50, phrase: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text, kept_sha256``."""
    k, w = phrase, words
    folder, blocks = write_blocks(docs, word_symbols, k, w, id_col, text_col)

    def spell(block: int, table: pa.Table, rows: pa.Table) -> pa.Table:
        """The words of every phrase that this block speaks for, as it holds them."""
        wanted = np.sort(rows["anchor"].to_numpy().view(np.uint64))
        coded, ends = words_of(table["text"].combine_chunks())
        runs = grown(names_of(coded), 1, k)
        at = np.flatnonzero(np.isin(runs, wanted)) if len(wanted) else np.zeros(0, np.int64)
        at = at[at + k <= ends[np.searchsorted(ends, at, side="right")]] if len(at) else at
        numbers = coded.indices.to_numpy().astype(np.int64)[at[:, None] + np.arange(k)] if len(at) else np.zeros((0, k), np.int64)
        numbers, example = np.unique(numbers, axis=0, return_index=True)  # by words: two phrases of one name are two
        said = coded.dictionary.cast(pa.string()).take(pa.array(numbers.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * k, pa.int32()), said)
        return pa.table([pa.array(runs[at[example]].view(np.int64) if len(at) else [], pa.int64()), lists], names=["anchor", "words"])

    def locate(block: int, table: pa.Table, rows: pa.Table) -> pa.Table:
        """Occurrences of confirmed phrases, as the shard's automaton finds them word for word."""
        coded, ends = words_of(table["text"].combine_chunks())
        number, phrases = coded.indices.to_numpy().astype(np.int64), rows["words"].combine_chunks()
        numbers = pc.index_in(phrases.flatten(), value_set=coded.dictionary.cast(pa.string()))
        numbers = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, k)
        here = (numbers >= 0).all(axis=1)  # a phrase with a word that no document of the shard has
        numbers, anchor = numbers[here], rows["anchor"].to_numpy().view(np.uint64)[here]
        at, which = phrase_hits(number, ends, numbers) if len(numbers) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(at, kind="stable")
        hits, hit_phrase = at[order], anchor[which[order]]

        def is_hit(a: int, s: dict) -> np.ndarray:
            i = np.minimum(np.searchsorted(hits, s["place"] + a), max(0, len(hits) - 1))
            return (hits[i] == s["place"] + a) & (hit_phrase[i] == s["anchor"]) if len(hits) else np.zeros(len(s["place"]), bool)

        out = segment_table(block, table, names_of(coded) if len(hits) else np.zeros(0, np.uint64), ends if len(hits) else ends * 0, k, w, is_hit)
        release()
        return out

    def remove(block: int, table: pa.Table, rows: pa.Table) -> pa.Table:
        coded, ends = words_of(table["text"].combine_chunks())
        _, again = order_of(table)
        gone = mask_of(ends, again, rows, w)
        upto = np.concatenate([[0], np.cumsum(~gone)])
        cuts = upto[np.concatenate([[0], ends])]
        kept = coded.filter(pa.array(~gone)).dictionary_decode().cast(pa.string())
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), kept), " ")
        n = np.diff(np.concatenate([[0], ends]))
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in text.to_pylist()]
        return pa.table(
            [table["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(n - np.diff(cuts), pa.int64()), text, pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    again = stage(recurring(blocks), "recurring")
    spoken = by_block(blocks, again.where("block = home"), folder, spell, ["anchor"], "anchor long, words array<string>")
    homes = again.where("block = home").select("anchor", "blocks")
    phrases = stage(spoken.join(homes, "anchor"), "phrases")
    shards = salted_join(again.select("block", "anchor"), phrases, ["anchor"], "blocks", ["block"])
    located = stage(by_block(blocks, shards, folder, locate, ["anchor", "words"], SEGMENTS), "segments")
    gone = covered(blocks, located, folder, word_symbols, k, w, same_doc=False)
    return by_block(blocks, gone, folder, remove, ["row", "at", "n"], RESULT)
