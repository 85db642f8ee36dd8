"""Secrets in texts: patterns of known shapes, and stretches whose characters look random.

Patterns (``RULES``) give the base spans: matches from left to right, without overlaps within a kind,
long ones only. They always stay.

The entropy scan adds spans. Candidate strings are maximal runs of the characters of a class
(``CLASSES``). A window slides over a candidate; the counts of its characters change by the one that
enters and the one that leaves, and with them the sum of c * log2(c), so a step costs the same however wide the
window is. Windows whose Shannon entropy reaches the class's threshold are joined into spans where they
overlap or touch. A span is suppressed if the candidate matches an allow-list pattern (``ALLOW``), or if a base
span or a span of an earlier class covers it.

Places are code points, ends exclusive. Sums are of integers (c * log2(c) in units of 2**-40), so a window has
one entropy whatever came before it.

Results in odd cases: null and empty texts have no spans; a null id is carried through; repeated rows are scanned
each; a text of any length is one row, scanned in linear time; an empty table gives an empty result. Columns besides id
and text are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A shape of a secret: matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


class CharClass(NamedTuple):
    """Characters of candidates of at least ``window``, and the bits of entropy that a window must reach."""

    kind: str
    chars: str
    window: int
    bits: float


# Kinds in the order in which they are listed. A match of access or hex ends with its run of characters, so
# runs that are too short can be left out by the pattern; a short value of assign still takes up its text.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 24, 3.2),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 4.1),
)
#: Candidates that are no secrets, matched whole: words and numbers, paths of words, UUIDs, alphabets in order.
ALLOW = (
    r"[A-Za-z]+|[0-9]+",
    r"[/_=+-]*(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]{2,}|[0-9]{1,4}))*[/_=+-]*",
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i:.*(?:0123456789|abcdefghij|example|placeholder|changeme).*)",
)
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_UNIT = 1 << 40


def windows_above(text: str, width: int, bits: float, shares: list[int]) -> list[tuple[int, int]]:
    """Stretches of ``text`` that windows of ``width`` with at least ``bits`` of entropy cover; ``shares`` holds c * log2(c)."""
    # entropy = log2(width) - sum(c log2 c) / width
    most = math.floor((math.log2(width) - bits) * width * _UNIT + 1e-3)
    counts: dict[str, int] = {}
    total, out = 0, []
    for end, c in enumerate(text, 1):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += shares[n + 1] - shares[n]
        if end > width:
            gone = text[end - width - 1]
            n = counts[gone]
            counts[gone] = n - 1
            total += shares[n - 1] - shares[n]
        if end >= width and total <= most:
            if out and out[-1][1] >= end - width:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - width, end))
    return out


def _cover(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts in order, and how far the first 0, 1, 2 ... spans reach."""
    ordered = sorted(spans)
    return [s[0] for s in ordered], list(accumulate((s[1] for s in ordered), max, initial=-1))


class Scanner:
    """Spans of single texts."""

    def __init__(self, rules: Sequence[Rule] = RULES, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW):
        self.rules = [(r, re.compile(r.pattern, re.ASCII)) for r in rules]
        self.classes = [(c, re.compile(f"[{c.chars}]{{{c.window},}}"), [round(_UNIT * n * math.log2(n)) if n else 0 for n in range(c.window + 2)]) for c in classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow) if allow else r"(?!)", re.DOTALL)

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` of the patterns, kind by kind."""
        out = []
        for rule, pattern in self.rules:
            for m in pattern.finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out.append((*m.span(), rule.kind))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """All spans, by start, then kind as listed."""
        found = self.base(text)
        for c, candidates, shares in self.classes:
            starts, reach = _cover(found)
            for m in candidates.finditer(text):
                if self.allow.fullmatch(m.group()):
                    continue
                for a, b in windows_above(m.group(), c.window, c.bits, shares):
                    a, b = a + m.start(), b + m.start()
                    if reach[bisect_right(starts, a)] < b:
                        found.append((a, b, c.kind))
        order = {k.kind: i for i, (k, *_) in enumerate([*self.rules, *self.classes])}
        return sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    classes: Sequence[CharClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """One row per document: ``doc_id`` and its ``spans`` (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, classes, allow)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scanner.scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
