"""Token-id files: ids of whole documents end to end, with Elias-Fano coded boundaries.

A shard holds a range of ids in ascending order:

    ids (unsigned 16 or 32 bits, little-endian) | Elias-Fano boundaries | Elias-Fano document ids
    | footer | footer length (4 bytes) | b"TIDEIDS1"

Boundaries are the n + 1 offsets of the documents in the shard, in near-minimal space; document
ids are coded by their distance to the smallest. Null ids come first and are only counted.

Documents are range-partitioned by id, so every task writes one shard. A task gives its file a
name of its own and reports it in a manifest row; only rows of tasks that Spark has committed
are read, so retries and lost executors leave at most unread files. A shard's place in the
whole is the running sum over the manifest, one row per shard.

Results in odd cases: a null text counts as empty and gets its end id alone; rows that repeat an
id follow each other in the order of their text; an empty table writes an empty manifest and
reads back empty. Columns besides id and text are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import elias_fano
from tidemark.llm.common import new_path, partitions_for, stage
from tidemark.llm.tokens import memo

MAGIC = b"TIDEIDS1"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_text_bytes: int = 32 << 20,
) -> DataFrame:
    """Write shards to ``folder`` (a new one in the shared folder by default); returns the manifest."""
    folder = folder or new_path(docs.sparkSession, "token-files")
    shards = partitions_for(docs, text_col, shard_text_bytes)
    ranged = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, ids_of, sizes = memo(tokenizer_path), None, [], []
        for batch in batches:
            if out is None:
                wide = encoder.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
                filesystem, at = _filesystem(folder)
                filesystem.create_dir(at, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.ids"
                out = filesystem.open_output_stream(f"{at}/{name}")
            ids_of.append(batch.column(0))
            for _, ids, lengths in encoder.encode(batch.column(1)):
                sizes.append(lengths + 1)
                whole = np.insert(ids, np.cumsum(lengths), end_id)
                out.write(whole.astype("<u4" if wide else "<u2").tobytes())
        encoder.rest()
        if out is None:
            return
        ids_of, sizes = pa.chunked_array(ids_of).combine_chunks(), np.concatenate(sizes)
        nulls, base = ids_of.null_count, 0
        known = ids_of.drop_null().to_numpy()
        if len(known):
            base = int(known[0])
        bounds = elias_fano.encode(np.concatenate([[0], np.cumsum(sizes)]))
        names = elias_fano.encode(known - base)
        footer = json.dumps(
            {"bytes": 4 if wide else 2, "tokens": int(sizes.sum()), "bounds": len(bounds), "names": len(names), "base": base, "nulls": nulls}
        ).encode()
        out.write(bounds + names + footer + struct.pack("<I", len(footer)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]),
             pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())],
            names=["shard", "path", "n_docs", "n_tokens"],
        )

    return stage(ranged.mapInArrow(run, MANIFEST), "token-manifest")


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str):
        filesystem, at = _filesystem(path)
        self.file = filesystem.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(min(size, 4096), max(0, size - 4096))
        if tail[-8:] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        length = struct.unpack("<I", tail[-12:-8])[0]
        self.footer = json.loads(tail[-12 - length : -12])
        at = self.footer["tokens"] * self.footer["bytes"]
        index = self.file.read_at(self.footer["bounds"] + self.footer["names"], at)
        self.bounds = elias_fano.EliasFano(index[: self.footer["bounds"]])
        self.names = elias_fano.EliasFano(index[self.footer["bounds"] :])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def ids(self, start: int, end: int) -> np.ndarray:
        wide = self.footer["bytes"]
        return np.frombuffer(self.file.read_at((end - start) * wide, start * wide), f"<u{wide}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_id(self, i: int) -> int | None:
        """Id of the i-th document; null ids come first."""
        nulls = self.footer["nulls"]
        return None if i < nulls else self.names.select(i - nulls) + self.footer["base"]

    def doc_ids(self, a: int, b: int) -> pa.Array:
        """Ids of the documents from the a-th to before the b-th."""
        nulls = min(max(self.footer["nulls"] - a, 0), b - a)
        known = self.names.span(a + nulls - self.footer["nulls"], b - self.footer["nulls"]) if nulls < b - a else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known + self.footer["base"], pa.int64())])


def read_tokens(manifest: DataFrame, docs_at_once: int = 2000) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``, places and ids found by select."""
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                for a in range(0, len(shard), docs_at_once):
                    b = min(a + docs_at_once, len(shard))
                    bounds = shard.bounds.span(a, b + 1)  # no table of the whole
                    ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    at = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [shard.doc_ids(a, b), pa.array(bounds[:-1] + row["base"], pa.int64()),
                         pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = shards.repartitionByRange(max(1, manifest.count()), "shard")
    return spread.select("path", "base").mapInArrow(run, RECORDS)
