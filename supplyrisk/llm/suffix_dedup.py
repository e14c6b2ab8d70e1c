"""Repeated passages by enhanced suffix arrays and their common-prefix interval trees.

Every ``length``-byte string belongs to the smallest hash of its
``gram``-byte substrings, so equal strings always meet under one key.
Steps:

1. texts that are equal as a whole form a class; its smallest doc_id
   stands for it, the other copies are repeats from end to end;
2. ``shared.shared_values`` finds the keys that two classes or more hold;
3. the stretches of text whose strings have a shared key are cut out and
   sent to one task per key range.  A task sends equal stretches once, for
   the smallest doc_id, so a passage that a large share of the documents
   holds costs one stretch per task;
4. a task sorts the suffixes of its stretches (a suffix array of the
   positions where a string starts), finds the intervals of equal strings,
   drops those that every occurrence extends to the left in the same way,
   and scans the others' longest-common-prefix array with a stack.  Each
   interval of the tree whose occurrences differ on the left is a maximal
   repeat; it is reported with all its occurrences.

Repeats are cut at the ends of the stretches; neighbouring stretches
overlap, so the union of a document's repeats is not.  Offsets are UTF-8
bytes.

Defined cases: null text is empty; texts shorter than ``length`` have no
repeats; a document with null doc_id is never compared; rows with the same
doc_id do not repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.shared import _KEY, bucket_count, identity, shared_values
from supplyrisk.llm.shingles import chunks, mix, utf8
from supplyrisk.plans import materialize

LENGTH, GRAM = 50, 24
_DOC = np.uint64(0x9E3779B97F4A7C15)


def _words(data: bytes, order: str = "<") -> np.ndarray:
    """The eight bytes at every position as one number."""
    n = max(len(data) - 7, 0)
    return np.ndarray((n,), f"{order}u8", data, 0, (1,)).astype(np.uint64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text index, start, end) of the runs of strings with one key, in order; ends cover the last string."""
    data = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    words = _words(data)
    n = len(data) - GRAM + 1
    grams = words[:n]
    for at in range(8, GRAM, 8):
        grams = mix(grams * _DOC) + words[at:at + n]
    least = _least(mix(grams * _DOC), LENGTH - GRAM + 1)
    pos = np.arange(len(least))
    text = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
    inside = pos + LENGTH <= ends[text]
    new = inside & np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    # a run lasts until the next begins or the text's strings end
    last = np.minimum(np.r_[first[1:], len(least)], ends[text[first]] - LENGTH + 1) - 1
    base = (ends - sizes)[text[first]]
    return least[first], text[first], first - base, last + LENGTH - base


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct stretch keys per text, for ``shared_values``; owners are classes of equal texts."""
    key, who, _, _ = stretches(texts)
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])] if len(key) else np.zeros(0, bool)
    owners = np.zeros(len(texts), _KEY)
    digests = np.frombuffer(b"".join(hashlib.md5(t).digest() for t in texts), ">u8").reshape(-1, 2)
    owners["hi"], owners["lo"] = digests[:, 0], digests[:, 1]
    return key[first], who[first], owners


def _bounded(cuts: Iterator[tuple[int, int, int, int]], most: int = 32) -> Iterator[tuple[int, int, int, int]]:
    """Stretches with more than ``most`` strings (text of one short period) in overlapping parts."""
    for t, a, b, k in cuts:
        for at in range(a, b - LENGTH + 1, most):
            yield t, at, min(b, at + most + LENGTH - 1), k


_CUT = "kind int, slot int, docs binary, starts binary, ends binary, data binary"


def _cut_row(kind: int, slot: int, rows: list[tuple], data: bytes) -> dict:
    docs, starts, ends = (np.array(c, "<i8").tobytes() for c in zip(*rows))
    return {"kind": kind, "slot": slot, "docs": docs, "starts": starts, "ends": ends, "data": data}


def _cut(buckets: int, slots: int):
    """Stretches with a shared key (kind 0, packed per key range) and repeats settled within the task (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int32()),
                        *((c, pa.binary()) for c in ("docs", "starts", "ends", "data"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            docs, texts, vals = batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                key, who, start, end = stretches(texts[lo:hi])
                if not len(key):
                    continue
                same = identity(key, buckets)
                held = [np.frombuffer(v, "<u8") for v in vals[lo:hi]]
                owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), [len(v) for v in held])
                hit = np.flatnonzero(np.isin(mix(same + who.astype(np.uint64) * _DOC),
                                             mix(np.concatenate(held) + owner * _DOC)))
                slot = (mix(key[hit]) % np.uint64(slots)).astype(np.int64).tolist()
                out: dict[int, tuple[list, list]] = {}
                settled: list[tuple] = []
                for t, a, b, k in _bounded(zip(who[hit].tolist(), start[hit].tolist(), end[hit].tolist(), slot)):
                    doc, piece = docs[lo + t], texts[lo + t][a:b]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    if seen.setdefault(digest, doc) < doc:
                        if settled and settled[-1][0] == doc and settled[-1][2] >= a:
                            settled[-1] = (doc, settled[-1][1], b)
                        else:
                            settled.append((doc, a, b))
                        continue
                    rows, data = out.setdefault(k, ([], []))
                    rows.append((doc, a, b))
                    data.append(piece)
                rows = [_cut_row(0, k, r, b"".join(d)) for k, (r, d) in sorted(out.items())]
                if settled:
                    rows.append(_cut_row(1, part % slots, settled, b""))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def interval_repeats(left: list[int], lcp: list[int], doc: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan over sorted suffixes: (length, first, last, smallest doc) of the maximal repeats.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i (0 between
    groups).  ``left`` is the byte before a suffix, -1 where none is known,
    which differs from every other.  Each open interval carries the smallest
    document and the one byte before all its suffixes, or -1 once they
    differ, so closing one is a constant step.
    """
    stack: list[list[int]] = []   # [length, first, smallest doc, left byte]
    n = len(left)
    for i in range(1, n + 1):
        height = lcp[i] if i < n else 0
        first, low, before = i - 1, doc[i - 1], left[i - 1]
        while stack and stack[-1][0] > height:
            top = stack.pop()
            low = low if low < top[2] else top[2]
            before = before if before == top[3] else -1
            first = top[1]
            if before == -1:
                yield top[0], first, i - 1, low
        if stack and stack[-1][0] == height:
            top = stack[-1]
            top[2] = low if low < top[2] else top[2]
            top[3] = before if before == top[3] else -1
        elif height:
            stack.append([height, first, low, before])


class Repeats:
    """Maximal repeats over several documents among stretches of text.

    ``doc``, ``start`` and ``end`` describe the suffixes of the left-diverse
    intervals in suffix order; repeat r is the ``length[r]`` bytes at the
    start of the suffixes ``lo[r]`` to ``hi[r]``, ``first_doc[r]`` the
    smallest document among them.
    """

    def __init__(self, docs: np.ndarray, starts: np.ndarray, pieces: list[bytes]):
        data = b"".join([*pieces, bytes(8)])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        base = np.cumsum(sizes) - sizes
        count = sizes - LENGTH + 1
        piece = np.repeat(np.arange(len(pieces)), count)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        at = base[piece] + offset
        words = _words(data, ">")
        # lexicographic order of the strings: their eight-byte words, the last one overlapping
        columns = [words[at + k] for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]]
        order = np.lexsort(columns[::-1])
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            c = c[order]
            same &= c[1:] == c[:-1]
        del columns
        edge = np.flatnonzero(np.r_[True, ~same])
        piece, offset, at = piece[order], offset[order], at[order]
        doc = docs[piece]
        before = np.where(offset > 0, np.frombuffer(data, np.uint8)[np.maximum(at - 1, 0)].astype(np.int64), -1)
        low, high = np.minimum.reduceat(before, edge), np.maximum.reduceat(before, edge)
        wanted = (np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)) & ((low < 0) | (low != high))
        group = np.cumsum(np.r_[True, ~same]) - 1
        keep = np.flatnonzero(wanted[group])
        if not len(keep):
            self.doc = self.start = self.length = self.lo = self.hi = self.first_doc = np.zeros(0, np.int64)
            return
        group, piece, offset, at, before = group[keep], piece[keep], offset[keep], at[keep], before[keep]
        # within the groups, order by what follows the string, up to the stretch's end
        room = sizes[piece] - offset

        def word(k: int) -> np.ndarray:
            """Bytes k to k + 7 of the suffixes, zero beyond their ends."""
            over = np.clip(k + 8 - room, 0, 8).astype(np.uint64) * np.uint64(8)
            value = words[np.minimum(at + k, len(words) - 1)]
            return np.where(over >= 64, np.uint64(0), (value >> np.minimum(over, np.uint64(63))) << np.minimum(over, np.uint64(63)))

        reach = int(room.max())
        order = np.lexsort([room, *[word(k) for k in range(LENGTH, reach, 8)][::-1], group])
        group, piece, offset, at, before, room = (x[order] for x in (group, piece, offset, at, before, room))
        lcp = np.full(len(order), LENGTH, np.int64)
        going = np.r_[False, group[1:] == group[:-1]]
        lcp[~going] = 0
        for k in range(LENGTH, reach, 8):
            w = word(k)
            differ = np.r_[np.uint64(0), w[1:] ^ w[:-1]]
            # equal bytes in front: a leading zero byte of the difference each
            lcp += going * sum((differ < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
            lcp += going & (differ == 0)
            going &= differ == 0
        shorter = np.minimum(room, np.r_[0, room[:-1]])
        lcp = np.where(lcp > 0, np.minimum(lcp, shorter), 0)
        self.doc, self.start = docs[piece], starts[piece] + offset
        found = list(interval_repeats(before.tolist(), lcp.tolist(), self.doc.tolist()))
        self.length, self.lo, self.hi, self.first_doc = np.array(found, np.int64).reshape(-1, 4).T

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(repeat, suffix) of every occurrence."""
        n = self.hi - self.lo + 1
        repeat = np.repeat(np.arange(len(n)), n)
        return repeat, np.arange(len(repeat)) - np.repeat(np.cumsum(n) - n, n) + self.lo[repeat]

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, end) of the longest repeat at each place that a smaller document has too."""
        repeat, suffix = self.occurrences()
        later = self.doc[suffix] > self.first_doc[repeat]
        longest = np.zeros(len(self.doc), np.int64)
        np.maximum.at(longest, suffix[later], self.length[repeat[later]])
        at = np.flatnonzero(longest)
        return self.doc[at], self.start[at], self.start[at] + longest[at]


REPEATS = "doc_id long, start long, end long, first_doc long"


def _repeats(every: bool):
    """Occurrences (doc_id, start, end, first_doc) of repeats; with ``every`` all of them, else only the longest
    at each place that a smaller document has too."""
    def columns(doc, start, end, first=None) -> pa.RecordBatch:
        first = pa.nulls(len(doc), pa.int64()) if first is None else pa.array(first)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "start": pa.array(start), "end": pa.array(end),
                                           "first_doc": first})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        for (kind, _), group in groupby(stream, key=lambda r: (r["kind"], r["slot"])):
            docs, starts, pieces = [], [], []
            for r in group:
                d, s, e = (np.frombuffer(r[c], "<i8") for c in ("docs", "starts", "ends"))
                if kind == 1:   # a smaller document of the same task has it
                    yield columns(d, s, e)
                    continue
                cuts = np.cumsum(e - s).tolist()
                pieces += [r["data"][a:b] for a, b in zip([0, *cuts], cuts)]
                docs.append(d)
                starts.append(s)
            if not pieces:
                continue
            found = Repeats(np.concatenate(docs), np.concatenate(starts), pieces)
            if every:
                repeat, suffix = found.occurrences()
                for a in range(0, len(repeat), 50_000):
                    r, x = repeat[a:a + 50_000], suffix[a:a + 50_000]
                    yield columns(found.doc[x], found.start[x], found.start[x] + found.length[r], found.first_doc[r])
            else:
                yield columns(*found.covered())
    return run


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("key"))


def _spread(keyed: DataFrame) -> DataFrame:
    """Texts dealt by document; both joins below use this one exchange."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "doc_id", "key")


def document_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, key, first_doc, vals): the class of equal texts, its smallest doc_id, the shared keys of that one."""
    classes = materialize(_keyed(documents).select("doc_id", "key").filter(F.col("doc_id").isNotNull()).distinct(),
                          name="classes")
    first = classes.groupBy("key").agg(F.min("doc_id").alias("first_doc"))
    shared = shared_values(documents.filter(F.col("doc_id").isNotNull()), keys_of)
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    vals = shared.select(F.concat(half("hi"), half("lo")).alias("key"), "vals")
    known = first.join(vals, "key", "left")
    return materialize(classes.join(known, "key").select(
        "doc_id", "key", "first_doc", F.when(F.col("doc_id") == F.col("first_doc"), F.col("vals")).alias("vals")),
        name="doc-classes")


def repeats(documents: DataFrame, classes: DataFrame | None = None, every: bool = True) -> DataFrame:
    """(doc_id, start, end, first_doc): the occurrences of maximal repeats between classes of texts.

    Occurrences settled inside one task carry no first_doc: a smaller
    document has them, which one is not kept.  Without ``every`` only the
    longest repeat at each place that a smaller document has too.
    """
    classes = document_classes(documents) if classes is None else classes
    slots = bucket_count(documents.sparkSession)
    # sixteen key ranges per task, one after the other: few of the suffixes are in memory at a time
    texts = _spread(_keyed(documents)).join(classes.select("doc_id", "key", "vals"), ["doc_id", "key"], "left") \
        .select("doc_id", "text", "vals").sortWithinPartitions("doc_id")
    return texts.mapInArrow(_cut(slots, 16 * slots), _CUT).repartition(slots, "kind", "slot") \
                .sortWithinPartitions("kind", "slot").mapInArrow(_repeats(every), REPEATS)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without the bytes that a smaller doc_id repeats."""
    classes = document_classes(documents)
    found = repeats(documents, classes, every=False)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    info = classes.select("doc_id", "key", (F.col("doc_id") != F.col("first_doc")).alias("copy")) \
                  .join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, copy, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = [(0, len(text))] if copy and len(text) >= LENGTH else \
                    [] if copy else _union([(s["start"], s["end"]) for s in spans or []])
                edges = [0, *(x for s in gone for x in s), len(text)]
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in gone))
                out["n_spans"].append(len(gone))
                out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0),
                                              **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                                              "kept": pa.array(out["kept"], pa.binary())})

    return _spread(_keyed(documents)).join(info, ["doc_id", "key"], "left") \
        .select("doc_id", "text", "copy", "spans").mapInArrow(run, KEPT)
