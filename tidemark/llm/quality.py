"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Words are coded by two of ``BUCKETS`` buckets: one of their letters, one of what stands around them
(case, length, punctuation and digits). Every bucket has a fixed sparse random index vector; the
context vector of a bucket is the sum of the index vectors of the words next to its words, counted
over all documents (random indexing, Kanerva, Kristoferson and Holst 2000). Counts are integers,
so their order does not matter, and the table has a fixed size; task tables are summed in a tree.
A document's vector is the mean of the context vectors of its words for either code. A two-layer
numpy network learns from at most ``most_labels`` labelled documents, the smallest by a hash of their
id; a tenth of them sets the temperature of its probabilities.

Labels decide nothing but the loss: id, language and source are no inputs, nor do rows take part
in learning whose crc32 of the id modulo ``folds`` is 0.

Results in odd cases: null and empty texts have a zero vector and get the network's score for it;
null labels are left out, and labels that disagree count by their mean; without labels of both
kinds every score is the share of good labels, 0.5 if there are none; a null id is held out and
scored; an empty table gives an empty result. Columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.phrase_dedup import words_of
from tidemark.llm.tokens import release

BUCKETS, DIM, SEED = 4096, 32, 20240229
#: Words whose vectors are summed at once.
PART_WORDS = 1 << 16


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors: of every bucket's DIM places, 4 hold 1 or -1."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((2 * BUCKETS, DIM), np.int64)
    for _ in range(4):
        out[np.arange(2 * BUCKETS), rng.integers(0, DIM, 2 * BUCKETS)] = rng.choice([-1, 1], 2 * BUCKETS)
    return out


def word_codes(words: list[str]) -> np.ndarray:
    """Two buckets per word: letters, and surroundings."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = np.zeros((len(words), 2), np.int64)
    for i, word in enumerate(words):
        letters = "".join([c for c in word if c.isalpha()])
        rest = "".join(["a" if c.isalpha() else c for c in word])
        while "aa" in rest:
            rest = rest.replace("aa", "a")
        case = "U" if len(letters) > 1 and letters.isupper() else "T" if letters[:1].isupper() else "l"
        out[i] = digest(letters.lower()) % BUCKETS, BUCKETS + digest(f"{case}{min(len(letters), 12)}{rest[:16]}") % BUCKETS
    return out


def _chunks(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff((np.cumsum(length) - length) // size)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if a < b:
            yield int(a), texts.slice(a, b - a)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, ends = words_of(texts)
    codes = word_codes(words.dictionary.to_pylist())
    return codes[words.indices.to_numpy()] if len(words) else np.zeros((0, 2), np.int64), ends


def _sum_by(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``target[rows] += values`` for repeated rows."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    if len(heads):
        target[rows[heads]] += np.add.reduceat(values, heads, axis=0)


def context_table(docs: DataFrame, text_col: str = "text", fan_in: int = 16) -> np.ndarray:
    """Context vectors of all buckets over all documents, scaled to unit length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors().astype(np.int32), np.zeros((2 * BUCKETS, DIM), np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                codes, ends = _coded(texts)
                doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                for a in range(0, len(codes), PART_WORDS):
                    part = codes[a : a + PART_WORDS + 1]
                    own = index[part[:, 0]] + index[part[:, 1]]
                    near = np.zeros_like(own)
                    same = (doc[a : a + len(part) - 1] == doc[a + 1 : a + len(part)])[:, None]
                    near[1:] += own[:-1] * same
                    near[:-1] += own[1:] * same
                    for j in (0, 1):
                        _sum_by(table, part[:, j], near)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["table"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * BUCKETS, DIM), np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), np.int64).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["table"])

    tables = stage(docs.select(text_col).mapInArrow(count, "table binary"), "context-tables")
    parts = tables.count()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        tables = stage(tables.repartition(parts).mapInArrow(add, "table binary"), "context-tables")
    total = np.zeros((2 * BUCKETS, DIM), np.float64)
    for row in tables.collect():  # at most fan_in tables of one fixed size
        total += np.frombuffer(row["table"], np.int64).reshape(total.shape)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1.0)).astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, vector``: mean context vector of the words for either code, and the mean size of both."""
    packed = table.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.frombuffer(packed, np.float32).reshape(2 * BUCKETS, DIM)
        for batch in batches:
            for first, texts in _chunks(batch.column(1)):
                codes, ends = _coded(texts)
                sums = np.zeros((len(ends), 2 * DIM), np.float32)
                doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                for a in range(0, len(codes), PART_WORDS):
                    part, of = codes[a : a + PART_WORDS], doc[a : a + PART_WORDS]
                    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    for j in (0, 1):
                        sums[of[heads], j * DIM : (j + 1) * DIM] += np.add.reduceat(vectors[part[:, j]], heads, axis=0)
                n = np.diff(np.concatenate([[0], ends]))[:, None]
                mean = sums / np.maximum(n, 1)
                flat = pa.array(mean.astype(np.float32).ravel(), pa.float32())
                offsets = pa.array(np.arange(len(mean) + 1) * 2 * DIM, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ends)), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "vector"]
                )
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, vector array<float>")


class Network:
    """Standardised input, one hidden layer of tanh units, a logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 0.005):
        rng = np.random.default_rng(SEED)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.flat = len(y) < 20 or y.min() == y.max()
        if self.flat:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        aside = np.arange(len(y)) % 10 == 9
        xt, yt = x[~aside], y[~aside]
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for a in range(0, len(order), batch):
                xb, yb = xt[order[a : a + batch]], yt[order[a : a + batch]]
                h = np.tanh(xb @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - yb) / len(yb)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [xb.T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
                t += 1
                for p, g, mi, vi in zip(self.w, grads, m, v):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
        z, ya = self._logit(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, np.where(ya > 0.5, -z, z) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        z = np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)
        return 1 / (1 + np.exp(-z))


def held_out(id_col: str, folds: int = 5):
    """True where crc32 of the id as text, modulo ``folds``, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    folds: int = 5,
    most_labels: int = 20_000,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    vectors = stage(pooled(docs, context_table(docs, text_col), id_col, text_col), "pooled")
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds))
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    learn = vectors.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()
    x = np.array([r["vector"] for r in learn], np.float64).reshape(len(learn), 2 * DIM)
    network = Network(x, np.array([float(r["y"] >= 0.5) for r in learn]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), 2 * DIM).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x), pa.float64())], names=["doc_id", "score"])

    scored = vectors.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns, whose names may be any."""
    bad = score_quality(docs, labels, id_col, **options).where("predicted = 0")
    bad = stage(bad.select("doc_id").distinct(), "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")
