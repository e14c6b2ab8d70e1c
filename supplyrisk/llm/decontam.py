"""Benchmark decontamination by SimHash over item-sized windows and a Hamming multi-index.

An item of L words is compared with windows of L words of a document, at
every word (windows over a document's edge are cut to it).  Item and window
have a 64-bit SimHash of their five-word shingles, each occurrence counted.

1. Every document is scanned once.  A window is kept when its shingles can
   reach the threshold with any item of its length: of a window's shingles,
   at most (1 - t) / t as many may be unknown as are known.  Known means
   "in the bitmap" of (shingle, length) pairs of the benchmark, a filter of
   fixed size that errs on the side of known, so nothing is lost.
2. The multi-index is a table: the fingerprint of every item in four blocks
   of 16 bits, each with all values within a quarter of the radius.  If two
   fingerprints differ in at most ``radius`` bits, one block differs in at
   most a quarter of them, so joining the windows' own block values with the
   table finds every pair within the radius.  Equal windows are looked up once.
3. Pairs within the radius are verified by the exact weighted Jaccard
   similarity of their shingle sets, at least ``percent`` hundredths, in
   integers.  A shingle's weight is ``ln(1 + items / items holding it)`` in
   steps of 2^-20, so stock phrases of the benchmark count less; one that no
   item holds weighs as if one did.

Everything but the bitmap (2^filter_bits / 8 bytes) and the list of
distinct item lengths (fewer than the square root of twice the benchmark's
words) stays in tables, whatever the size of the benchmark.  Documents are not
shuffled; ``clean`` shuffles those with a window kept in step 1, no others.

Words are runs of letters and digits, ASCII case folded.  Defined cases:
null or empty texts and items match nothing; an item of fewer than five
words is one shingle and matches documents of just those words; rows of one
id and text are judged alike and reported once, null ids too; items that
share an id report their best window; of equally similar windows the first
counts; very long texts are scanned whole, window by window; an empty
benchmark or table matches nothing; other columns are ignored or passed
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.shingles import NOT_ALNUM, byte_table, chunks, mix, shingles, utf8, word_counts, word_hashes
from supplyrisk.plans import materialize

WIDTH = 5
BLOCKS, BLOCK_BITS = 4, 16
STEP = 1 << 20   # weights are whole numbers of this part
_TABLE = byte_table(NOT_ALNUM)
_ITEMS = "item_id long, n_words int, print long, vals array<long>"
_WINDOWS = "doc_id long, h long, first_word long, n_words int, print long, vals array<long>"


def fingerprints(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash per owner of its values (owners ascending)."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((n, 64), dtype=np.int32)
    if len(owner):
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total[owner[head]] = np.add.reduceat(bits.astype(np.int32) * 2 - 1, head, axis=0)
    return np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()


def _places(values: np.ndarray, n_words: np.ndarray, filter_bits: int) -> np.ndarray:
    """Bit of a (shingle, item length) pair in the filter; length 0 stands for any."""
    if not n_words.any():
        return values >> np.uint64(64 - filter_bits)   # a shingle's value is a hash already
    return mix(values ^ mix(n_words.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - filter_bits)


class Known:
    """The filter of the benchmark's shingles: (shingle, length) -> may be known."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, filter_bits: int):
        self.words, self.lengths, self.filter_bits = words, lengths, filter_bits

    def __call__(self, values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        at = _places(values, n_words, self.filter_bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def item_table(benchmark: DataFrame) -> DataFrame:
    """(iid, item_id, n_words, print, vals) of the items with a word, written once; ``iid`` is unique."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts):
                hashes, owner = word_hashes(texts[lo:hi], _TABLE)
                value, who, at = shingles(hashes, owner, hi - lo, WIDTH)
                order = np.lexsort((at, who))
                value, who = value[order], who[order]
                n = word_counts(owner, hi - lo)
                has = np.flatnonzero(n)
                prints = fingerprints(value, who, hi - lo)
                ends = np.searchsorted(who, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pydict({
                    "item_id": batch.column(0).slice(lo, hi - lo).take(pa.array(has)), "n_words": pa.array(n[has].astype(np.int32)),
                    "print": pa.array(prints[has].view(np.int64)),
                    "vals": pa.array([np.unique(value[ends[i]:ends[i + 1]]).view(np.int64) for i in has], pa.list_(pa.int64()))})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return materialize(items.mapInArrow(run, _ITEMS).withColumn("iid", F.monotonically_increasing_id()), name="items")


def known_shingles(items: DataFrame, filter_bits: int) -> Broadcast:
    """The filter over all items, built in tasks and put together by bitwise or."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            values = batch.column(1).flatten().to_numpy().view(np.uint64)
            n_words = np.repeat(batch.column(0).to_numpy(), sizes)
            at = np.unique(np.r_[_places(values, n_words, filter_bits), _places(values, np.zeros_like(n_words), filter_bits)])
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word[first]),
                                              "bits": pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64) if len(first) else first)})

    parts = items.select("n_words", "vals").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = parts.toArrow()   # at most 2^(filter_bits - 6) rows
    words = np.zeros(1 << (filter_bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    lengths = np.array(sorted(r[0] for r in items.select("n_words").distinct().collect()), np.int64)
    return items.sparkSession.sparkContext.broadcast(Known(words, lengths, filter_bits))


def _windows(texts: list[bytes], known: Known, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list]]:
    """(text index, length, first words, fingerprints, shingle sets) of the windows that can match an item."""
    hashes, owner = word_hashes(texts, _TABLE)
    value, who, at = shingles(hashes, owner, len(texts), WIDTH)
    if not len(value) or not len(known.lengths):
        return
    hit = known(value, np.zeros(1, np.int64))
    some = np.zeros(len(texts), bool)
    some[who[hit]] = True
    rows = np.flatnonzero(some[who])
    rows = rows[np.lexsort((at[rows], who[rows]))]
    value, who, hit = value[rows], who[rows], hit[rows]
    ends = np.searchsorted(who, np.arange(len(texts) + 1))
    for t in np.flatnonzero(some).tolist():
        v, at_hit = value[ends[t]:ends[t + 1]], np.flatnonzero(hit[ends[t]:ends[t + 1]])
        n = len(v)
        _, place, count = np.unique(v, return_inverse=True, return_counts=True)
        single = count[place] == 1   # a shingle that recurs in a window counts once, so only these are misses for sure
        for length in known.lengths.tolist():
            of_length = at_hit[known(v[at_hit], np.full(1, length))]
            if not len(of_length):
                continue
            m = max(length - WIDTH + 1, 1)
            mine = np.zeros(n, bool)
            mine[of_length] = True
            hits, misses = np.r_[0, np.cumsum(mine)], np.r_[0, np.cumsum(single & ~mine)]
            # windows that hold a known shingle of the length
            start = np.unique((of_length[:, None] - np.arange(m)).ravel()) if len(of_length) * m < 4 * n else np.arange(1 - m, n)
            a, b = np.maximum(start, 0), np.minimum(start + m, n)
            h = hits[b] - hits[a]
            ok = (h > 0) & ((misses[b] - misses[a]) * percent <= h * (100 - percent))
            start, a, b = start[ok], a[ok], b[ok]
            for lo in range(0, len(start), max(1, 100_000 // m)):
                s = slice(lo, lo + max(1, 100_000 // m))
                size = b[s] - a[s]
                own = np.repeat(np.arange(len(size)), size)
                pos = np.repeat(a[s], size) + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                yield t, length, start[s], fingerprints(v[pos], own, len(size)), [np.unique(v[i:j]) for i, j in zip(a[s], b[s])]


def _identity(documents: DataFrame) -> DataFrame:
    """(doc_id, text, h): rows of one id and text count as one."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def candidate_windows(documents: DataFrame, known: Broadcast, percent: int) -> DataFrame:
    """The windows that can match an item, with their fingerprint and shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts):
                for t, length, first, prints, sets in _windows(texts[lo:hi], known.value, percent):
                    row = pa.array(np.full(len(first), lo + t))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column(0).take(row), "h": batch.column(2).take(row), "first_word": pa.array(first),
                        "n_words": pa.array(np.full(len(first), length, np.int32)), "print": pa.array(prints.view(np.int64)),
                        "vals": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    return _identity(documents).mapInArrow(run, _WINDOWS)


def _block(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, (block * BLOCK_BITS)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def multi_index(items: DataFrame, radius: int) -> DataFrame:
    """(n_words, block, value, iid, item_print): per item and block all values within a quarter of the radius."""
    near = min(radius // BLOCKS, BLOCK_BITS)
    masks = [sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(BLOCK_BITS), k)]
    mask = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")
    rows = items.select("n_words", "iid", F.col("print").alias("item_print"),
                        F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])).alias("block"))
    return rows.withColumn("mask", F.explode(mask)) \
               .withColumn("value", _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("mask"))).drop("mask")


def _weights(items: DataFrame) -> tuple[DataFrame, Column]:
    """(value, w) of the benchmark's shingles, and the weight of all others."""
    n = items.select(F.count(F.lit(1))).scalar()
    held = items.select(F.explode("vals").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    weight = lambda k: F.round(F.log1p(n / k) * STEP).cast("long")
    return materialize(held.select("value", weight(F.col("n")).alias("w")), name="weights"), weight(F.lit(1))


def matches(windows: DataFrame, items: DataFrame, percent: int, radius: int) -> DataFrame:
    """(doc_id, h, item_id, first_word, similarity): the best verified window of every document and item.

    ``windows`` and ``items`` are written tables.
    """
    same = ["n_words", "print", "vals"]
    contents = materialize(windows.select(*same).distinct().withColumn("cid", F.monotonically_increasing_id()), name="contents")
    probe = contents.select("cid", "n_words", "print", F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])).alias("block")) \
                    .withColumn("value", _block(F.col("print"), F.col("block")))
    # the index grows with the benchmark and packs well, so its stored size says little: no broadcast of it
    found = probe.join(multi_index(items, radius).hint("merge"), ["n_words", "block", "value"]) \
                 .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = materialize(found.select("cid", "iid").distinct(), name="pairs")
    weights, other = _weights(items)
    of_item = items.select("iid", F.explode("vals").alias("value")).join(weights, "value")
    of_item = materialize(of_item, name="item-weights")
    of_content = contents.join(pairs.select("cid").distinct(), "cid").select("cid", F.explode("vals").alias("value"))
    of_content = materialize(of_content.join(weights, "value", "left").select("cid", "value", F.coalesce("w", other).alias("w")), name="content-weights")
    both = pairs.join(of_content, "cid").join(of_item.select("iid", "value"), ["iid", "value"]) \
                .groupBy("cid", "iid").agg(F.sum("w").alias("both"))
    total = lambda df, key, name: df.groupBy(key).agg(F.sum("w").alias(name))
    judged = both.join(total(of_content, "cid", "all_c"), "cid").join(total(of_item, "iid", "all_i"), "iid")
    union = F.col("all_c") + F.col("all_i") - F.col("both")
    good = materialize(judged.filter(100 * F.col("both") >= percent * union)
                             .select("cid", "iid", (F.col("both") / union).alias("similarity")), name="verified")
    placed = windows.join(contents, same).select("doc_id", "h", "first_word", "cid").join(good, "cid") \
                    .join(items.select("iid", "item_id"), "iid")
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("f"))).alias("b")
    return placed.groupBy("doc_id", "h", "item_id").agg(best) \
                 .select("doc_id", "h", "item_id", (-F.col("b.f")).alias("first_word"), F.col("b.similarity").alias("similarity"))


def find(documents: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 19, filter_bits: int = 24) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of every document and item that match."""
    items = item_table(benchmark)
    known = known_shingles(items, filter_bits)
    windows = materialize(candidate_windows(documents, known, percent), name="windows")
    return matches(windows, items, percent, radius).drop("h")


def clean(documents: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 19, filter_bits: int = 24) -> DataFrame:
    """The rows without a match, all columns.

    Rows without a window that could match are decided where they are read; the others meet the matches in a join.
    """
    items = item_table(benchmark)
    known = known_shingles(items, filter_bits)
    windows = materialize(candidate_windows(documents, known, percent), name="windows")
    bad = matches(windows, items, percent, radius).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    bad = materialize(bad, name="matched")
    at = documents.columns.index("text")

    def having(some: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = utf8(batch.column(at))
                has = np.zeros(len(texts), bool)
                for lo, hi in chunks(texts):
                    has[[lo + t for t, *_ in _windows(texts[lo:hi], known.value, percent)]] = True
                yield batch.filter(pa.array(has if some else ~has))
        return documents.mapInArrow(run, documents.schema)

    doubtful = having(True)
    same = doubtful["doc_id"].cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(doubtful["text"].cast("string")) == bad["_h"])
    return having(False).unionByName(doubtful.join(bad, same, "left_anti"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
