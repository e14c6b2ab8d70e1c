"""Token-ID files: flat unsigned integers plus 64-bit document offsets, read by memory map.

Documents are range-partitioned and sorted by doc_id; each task streams
its partition into ``part-NNNNN.bin`` (ids back to back, the end id after
every document) and ``part-NNNNN.idx`` (int64 doc_ids, then n + 1 uint64
offsets counted in ids from the file's start).  Tasks return one row per
file; a prefix sum over those rows gives each file its base, so a
document's global start is base + offset and nothing is renumbered.

The folder must be a mounted path that all executors share (a ``file:``
path), as memory mapping needs one.  A file appears under its name only
when it is complete, so a task that runs twice leaves one good copy.

Defined cases: null text is empty (the end id alone); rows sort by
(doc_id, text hash), so repeated rows keep a fixed order; null doc_ids
come first; an empty table writes no files; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplyrisk.llm.encoders import END_ID, encoder
from supplyrisk.plans import materialize

NULL_ID = -(1 << 63)   # stands for a null doc_id inside a file
MANIFEST = "part int, path string, n_docs long, n_ids long"


def shared_folder(path: str) -> str:
    """Local path of a ``file:`` URI or plain path; other stores cannot be memory-mapped."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted shared folder, not {url.scheme}:")
    return url.path


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, kind: str = "byte",
                      dtype: str = "<u2") -> DataFrame:
    """Write the files and return their manifest: (part, path, n_docs, n_ids, base).

    Every id of the vocabulary must fit ``dtype``.
    """
    root = shared_folder(folder)
    largest = max(encoder(vocabulary, kind).tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
    if largest > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {largest} do not fit {np.dtype(dtype).name}; use a wider dtype")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(vocabulary, kind)
        name = os.path.join(root, f"part-{part:05d}")
        temp = f"{name}.{uuid.uuid4().hex}"
        ids, sizes, out = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                os.makedirs(root, exist_ok=True)
                out = open(f"{temp}.bin", "wb")
            ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            for text in batch.column(1):
                got = np.frombuffer(enc.encode(text.as_py() or ""), "<u4")
                out.write(got.astype(dtype).tobytes())
                out.write(np.array([END_ID], dtype).tobytes())
                sizes.append(len(got) + 1)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        with open(f"{temp}.idx", "wb") as index:
            index.write(np.concatenate(ids).astype("<i8").tobytes() + offsets.tobytes())
        os.replace(f"{temp}.bin", f"{name}.bin")
        os.replace(f"{temp}.idx", f"{name}.idx")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [name], "n_docs": [len(sizes)],
            "n_ids": [int(offsets[-1])]})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), name="token-manifest")
    # one row per file; files are far fewer than documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files by memory map."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                head = np.memmap(f"{row['path']}.idx", mode="r", dtype=np.uint8)
                doc_ids = head[:8 * n].view("<i8")
                offsets = head[8 * n:].view("<u8").astype(np.int64)
                flat = np.memmap(f"{row['path']}.bin", dtype=dtype, mode="r")
                for lo in range(0, n, 20_000):
                    hi = min(n, lo + 20_000)
                    crc = [zlib.crc32(flat[offsets[i]:offsets[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    got = np.array(doc_ids[lo:hi])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(got, mask=got == NULL_ID),
                        "start": pa.array(offsets[lo:hi] + row["base"]),
                        "n_tokens": pa.array(np.diff(offsets[lo:hi + 1])), "ids_crc32": pa.array(crc, pa.int64())})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(read, schema)


def round_trip(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    return read_token_files(write_token_files(docs, folder, vocabulary))
