"""Which hashed features of a text do other texts have too?

``shared_values`` takes a function that turns texts into 64-bit feature
values and returns, per distinct owner, the values that at least two
owners hold, with the number of owners.  Owners are classes of equal
texts (a 128-bit key), so groups of copies count once.

Values travel as packed arrays, not as rows: a task packs about 1 MB of
text at a time into one row per hash bucket (the owners, how many values
each has there, and five bytes a value), one task per bucket counts the
owners, a part of the bucket's values at a time, and the values that are
shared go back, packed per range of owners.  A task sends a class once.  Buckets follow
``spark.sql.shuffle.partitions``; a value is told apart by its bucket and
40 more bits of its hash.

Values held by more than ``hot_share`` of the texts would make a bucket
hot.  They are found first, from the values that are frequent in single
stretches of text; at most average values per text / ``hot_share`` can
exist, so the list is small at any size.  They count as shared by
definition (owner count ``HOT``) and skip the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyrisk.llm.shingles import chunks, utf8

HOT = 65535
PART = 250_000   # values unpacked at a time
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])

#: texts -> (values, index of the text each belongs to, owner keys of _KEY); values distinct per text, texts ascending
Features = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def bucket_count(spark: SparkSession) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def identity(values: np.ndarray, buckets: int) -> np.ndarray:
    """The part of a hash that tells values apart: below ``buckets`` * 2^40, congruent to the bucket."""
    return values % np.uint64(buckets << 40)


def hot_values(docs: DataFrame, features: Features, hot_share: float, buckets: int) -> np.ndarray:
    """Sorted values held by more than ``hot_share`` of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in chunks(texts):
                value, n = np.unique(identity(features(texts[lo:hi])[0], buckets), return_counts=True)
                often = n >= max(8, hot_share * (hi - lo))
                yield pa.RecordBatch.from_pydict({"v": pa.array(value[often].astype(np.int64)),
                                                  "n": pa.array(n[often], pa.int64())})

    found = _texts(docs).mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    least = max(8.0, hot_share * docs.count())
    rows = found.filter(F.col("n") >= least).select("v").toPandas()
    return np.sort(rows["v"].to_numpy(dtype=np.uint64))


def _pack(q: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of numbers, as planes."""
    return np.ascontiguousarray(q.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


_PACKED = "kind int, slot int, owners binary, counts binary, q binary, df binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), *((c, pa.binary()) for c in ("owners", "counts", "q", "df"))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip(np.r_[0, edge].tolist(), np.r_[edge, len(x)].tolist()))


def _rows(kind: int, slot: np.ndarray, owner: np.ndarray, keys: np.ndarray, q: np.ndarray,
          df: np.ndarray | None = None) -> list[dict]:
    """One row per slot: its owners, values per owner, values.  Input is grouped by owner."""
    order = np.argsort(slot.astype(np.uint32), kind="stable")
    slot, owner, q = slot[order], owner[order], q[order]
    df = df[order] if df is not None else None
    out = []
    for a, b in _runs(slot):
        own, first = np.unique(owner[a:b], return_index=True)
        counts = np.diff(np.r_[first, b - a])
        out.append({"kind": kind, "slot": int(slot[a]), "owners": keys[own].tobytes(), "counts": counts.astype("<u4").tobytes(),
                    "q": _pack(q[a:b], 5 if kind == 0 else 8), "df": b"" if df is None else df[a:b].astype("<u2").tobytes()})
    return out


def _target(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys["lo"] % np.uint64(buckets)).astype(np.int64)


class _Held:
    """The packed rows of one slot: owner keys, owner index per value, and the values as byte planes.

    Values are unpacked a part at a time, so a task holds the packed bytes
    and the arrays of one part, however many values the slot has.
    """

    def __init__(self, rows: list[dict], width: int):
        every = np.concatenate([np.frombuffer(r["owners"], _KEY) for r in rows])
        order = np.lexsort((every["hi"], every["lo"]))
        s = every[order]
        new = np.r_[True, (s["hi"][1:] != s["hi"][:-1]) | (s["lo"][1:] != s["lo"][:-1])]
        index = np.empty(len(every), np.uint32)
        index[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        self.keys = s[new]
        self.owner = np.repeat(index, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]))
        self.planes = np.concatenate([np.frombuffer(r["q"], np.uint8).reshape(width, -1) for r in rows], axis=1)

    def parts(self, of: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the values, a part at a time; values with equal low bits of ``of`` are in one part."""
        parts = 1 << max(0, (len(self.owner) // PART).bit_length())
        for p in range(parts):
            yield np.flatnonzero((of & of.dtype.type(parts - 1)) == p) if parts > 1 else np.arange(len(self.owner))

    def values(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        for i, plane in enumerate(self.planes):
            out[:, i] = plane[at]
        return out.view("<u8").ravel()


def _slots(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows grouped by their place in the sort order; binaries stay views of the batch."""
    def rows() -> Iterator[dict]:
        for b in batches:
            ints = {c: b.column(c).to_pylist() for c in ("kind", "slot")}
            blobs = {c: b.column(c) for c in ("owners", "counts", "q", "df")}
            for i in range(b.num_rows):
                yield {**{c: v[i] for c, v in ints.items()}, **{c: v[i].as_buffer() for c, v in blobs.items()}}
    return groupby(rows(), key=lambda r: tuple(r[c] for c in by))


def shared_values(docs: DataFrame, features: Features, hot_share: float = 0.002) -> DataFrame:
    """(hi, lo, vals, df): per owner the values that two owners or more hold, and by how many.

    ``vals`` are ``identity`` values as little-endian int64 bytes,
    ascending; ``df`` are uint16 owner counts, capped at HOT.  Owners
    without a shared value have no row.
    """
    buckets = bucket_count(docs.sparkSession)
    hot = hot_values(docs, features, hot_share, buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in chunks(texts):
                values, who, keys = features(texts[lo:hi])
                fresh = np.zeros(len(keys), bool)
                for i, k in enumerate(keys):
                    if (b := k.tobytes()) not in sent:
                        sent.add(b)
                        fresh[i] = True
                mine = fresh[who]
                v, who = identity(values[mine], buckets), who[mine]
                if not len(v):
                    continue
                rows = []
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
                    own = who[is_hot]
                    rows += _rows(1, _target(keys[own], buckets), own, keys, v[is_hot], np.full(len(own), HOT))
                    v, who = v[~is_hot], who[~is_hot]
                q, slot = np.divmod(v, np.uint64(buckets))
                rows += _rows(0, slot, who, keys, q)
                if rows:
                    yield _batch(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, slot), group in _slots(batches, ("kind", "slot")):
            if kind == 1:
                for r in group:
                    yield _batch([{c: v if c in ("kind", "slot") else v.to_pybytes() for c, v in r.items()}])
                continue
            held, kept = _Held(list(group), 5), []

            def found() -> Iterator[pa.RecordBatch]:
                own, q, df = (np.concatenate(x) for x in zip(*kept))
                kept.clear()
                if len(own):
                    order = np.argsort(own, kind="stable")
                    own = own[order]
                    yield _batch(_rows(1, _target(held.keys[own], buckets), own, held.keys,
                                       q[order] * np.uint64(buckets) + np.uint64(slot), df[order]))

            for at in held.parts(held.planes[0]):   # equal values have equal low bytes
                q, own = held.values(at), held.owner[at]
                order = np.lexsort((own, q))
                q, own = q[order], own[order]
                first = np.r_[True, (q[1:] != q[:-1]) | (own[1:] != own[:-1])]
                q, own = q[first], own[first]
                edge = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                n = np.diff(np.r_[edge, len(q)])
                df = np.repeat(n, n)
                keep = df >= 2
                kept.append((own[keep], q[keep], np.minimum(df[keep], HOT).astype("<u2")))
                if sum(len(x[0]) for x in kept) >= PART:
                    yield from found()
            if kept:
                yield from found()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _slots(batches, ("slot",)):
            rows = list(group)
            held = _Held(rows, 8)
            dfs = np.concatenate([np.frombuffer(r["df"], "<u2") for r in rows])
            for at in held.parts(held.owner):
                own, value, df = held.owner[at], held.values(at), dfs[at]
                order = np.lexsort((value, own))
                own, value, df = own[order], value[order], df[order]
                first = np.r_[True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])]
                own, value, df = own[first], value[first], df[first]
                runs = _runs(own)
                for lo in range(0, len(runs), 2000):
                    part = runs[lo:lo + 2000]
                    k = held.keys[own[[a for a, _ in part]]]
                    yield pa.RecordBatch.from_pydict({
                        "hi": pa.array(k["hi"].view("<i8")), "lo": pa.array(k["lo"].view("<i8")),
                        "vals": [value[a:b].astype("<i8").tobytes() for a, b in part],
                        "df": [df[a:b].astype("<u2").tobytes() for a, b in part]})

    packed = _texts(docs).mapInArrow(pack, _PACKED)
    counted = packed.repartition(buckets, "kind", "slot").sortWithinPartitions("kind", "slot").mapInArrow(count, _PACKED)
    return counted.repartition(buckets, "slot").sortWithinPartitions("slot") \
                  .mapInArrow(gather, "hi long, lo long, vals binary, df binary")
