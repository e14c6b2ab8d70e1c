"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents longer than the capacity are cut into full pieces and a rest.
The bins are planned on the histogram of piece lengths (at most
``capacity`` rows, collected), by bin completion (``bin_completion``).
The plan has one row per filling and length, at most capacity x 63 rows,
as the distinct lengths of one bin add up to at most the capacity; each
row says which ranks of a length go where.  Pieces get their rank within
their length in two levels (inside salted groups, then the groups'
prefix sums), so a length that many documents share is never one task.

Defined cases: null text is empty (the end id alone); repeated rows are
packed like others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyrisk.llm.bin_completion import Filling, pack_counts
from supplyrisk.llm.encoders import END_ID, encoder
from supplyrisk.plans import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, vocabulary: str, kind: str = "word", capacity: int = 2048) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        end = int(END_ID).to_bytes(4, "little")
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    for k, v in zip(rows, (doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut))):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(rows["doc_id"], pa.int64()), "piece": pa.array(rows["piece"], pa.int32()),
                **{k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
               .mapInArrow(run, PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` (a written table) with ``rank``, 0-based within the length."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"),
                  F.lit(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)).cast("int")
    salted = pieces.withColumn("salt", salt)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("r", F.row_number().over(inside) - 1).join(bases, ["length", "salt"]) \
                 .withColumn("rank", F.col("first") + F.col("r")).drop("salt", "r", "first")


def slots(solution: list[tuple[Filling, int]]) -> np.ndarray:
    """Plan rows (length, first rank, per bin, first bin, offset), by length and rank."""
    taken: dict[int, int] = {}
    rows, bins = [], 0
    for filling, times in solution:
        offset = 0
        for length, per in filling:
            rows.append((length, taken.get(length, 0), per, bins, offset))
            taken[length] = taken.get(length, 0) + per * times
            offset += per * length
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, plan: np.ndarray) -> DataFrame:
    """Ranked pieces with ``sequence_id`` and ``offset`` looked up in the plan (bounded, see above)."""
    keys = plan[:, 0] * (1 << 50) + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1] if len(length) else plan[:0]
            turn, within = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            out = {f: batch.column(f) for f in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict({**out, "sequence_id": pa.array(row[:, 3] + turn, pa.int64()),
                                              "offset": pa.array(row[:, 4] + within * length, pa.int64())})

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "rank") \
                 .mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, kind: str = "word", capacity: int = 2048) -> DataFrame:
    """Every piece with its sequence and the offset there."""
    pieces = materialize(tokenize_pieces(docs, vocabulary, kind, capacity), name="pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    solution = pack_counts(counts, capacity)
    if full:
        solution = [(((capacity, 1),), full), *solution]
    return place(ranked(pieces), slots(solution))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the placement of every piece."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
