"""Hard-negative mining with inner products computed in residues of small primes.

Scores are inner products of integer vectors.  They come from float32
matrix products, exact by construction: both matrices are reduced modulo
a prime p to symmetric residues, p small enough that d * (p // 2)^2 stays
below 2^24, so no float32 sum can round.  The products modulo several
primes are put together by Chinese remaindering (mixed radix with balanced
digits, so negative scores need no case of their own), the primes' product
exceeding twice the bound that the vectors' lengths put on a score.

Rows lie in blocks of bounded size by a hash of their id.  Anchors
are sent to every block (they are the smaller side, nothing is broadcast)
and stream through the task that holds the block, so memory is one block
and one pack of anchors.  Two passes: each block returns per anchor its
first positives, and then, per anchor and positive, its first negatives
within the positive's window; window functions pick the first ones over
all blocks.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; vectors of different lengths have no
score; of rows with one id the least by (label, vector) takes part; ties
in score go to the smaller id; a negative positive_score has an empty
window; other columns are ignored; an empty table gives an empty result.
Scores beyond 2^62 raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyrisk.plans import materialize

PACK = 64        # anchors scored at a time
DEPTH = 1024     # components multiplied at a time
_SCORED = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def primes(depth: int) -> Iterator[int]:
    """Odd primes, largest first, with depth * (p // 2)^2 < 2^24."""
    top = 2 * int(np.sqrt((2**24 - 1) / depth)) + 1
    for p in range(top, 2, -1):
        if p % 2 and depth * (p // 2) ** 2 < 2**24 and all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            yield p


def moduli(bound: float, depth: int) -> list[int]:
    """Primes whose product exceeds ``2 * bound``."""
    if bound >= 2.0**62:
        raise ValueError("inner products beyond 2^62 do not fit a score")
    out, product = [], 1
    for p in primes(depth):
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Symmetric residues of whole numbers held as doubles, as float32."""
    r = np.fmod(x, p)   # exact for doubles of any size
    half = p // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


class Block:
    """Vectors of one length with their residues, reduced once per prime."""

    def __init__(self, x: np.ndarray):
        self.x, self.known = x, {}
        self.norm = float(np.sqrt((x * x).sum(1).max())) if len(x) else 0.0

    def residues(self, p: int) -> np.ndarray:
        if p not in self.known:
            self.known[p] = residues(self.x, p)
        return self.known[p]


def scores(a: Block, b: Block) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with the rows of ``b``, as int64."""
    d = a.x.shape[1]
    used = moduli(a.norm * b.norm * (1 + 1e-9) + 1, max(1, min(d, DEPTH)))
    total, product = np.zeros((len(a.x), len(b.x)), np.int64), 1
    for p in used:
        ra, rb = a.residues(p), b.residues(p)
        r = np.zeros(total.shape, np.int64)
        for lo in range(0, d, DEPTH):
            r += (ra[:, lo:lo + DEPTH] @ rb[:, lo:lo + DEPTH].T).astype(np.int64)
        digit = (r - total % p) * pow(product, -1, p) % p
        # balanced digits: what is put together so far is always the residue next to zero
        total += product * np.where(digit > p // 2, digit - p, digit)
        product *= p
    return total


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of every group, by score descending, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[place < k]


Pick = Callable[[np.ndarray, dict, dict], dict]


def _positives(k: int) -> Pick:
    def pick(s: np.ndarray, anchors: dict, rows: dict) -> dict:
        """The first ``k`` rows of the anchor's label other than the anchor."""
        same = (anchors["label"][:, None] == rows["label"]) & (anchors["vec_id"][:, None] != rows["vec_id"])
        who, row = np.nonzero(same)
        at = _first(who, s[who, row], rows["vec_id"][row], k)
        who, row = who[at], row[at]
        none = np.zeros(len(who), np.int64)
        return {"anchor_id": anchors["vec_id"][who], "positive_id": none, "positive_score": none,
                "vec_id": rows["vec_id"][row], "score": s[who, row]}
    return pick


def _negatives(k: int, percent: int) -> Pick:
    def pick(s: np.ndarray, anchors: dict, rows: dict) -> dict:
        """Per positive the first ``k`` rows of other labels with percent% of its score <= score <= its score."""
        out: dict[str, list] = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")}
        other = anchors["label"][:, None] != rows["label"]
        n = np.array([len(p) for p in anchors["positives"]])
        for j in range(n.max(initial=0)):   # the j-th positive of every anchor
            has = np.flatnonzero(n > j)
            pid, top = np.array([anchors["positives"][i][j] for i in has], np.int64).reshape(-1, 2).T
            low = top // 100 * percent + -(-(top % 100) * percent // 100)   # ceil(percent * top / 100)
            part = s[has]
            who, row = np.nonzero(other[has] & (part <= top[:, None]) & (part >= low[:, None]))
            at = _first(who, part[who, row], rows["vec_id"][row], k)
            who, row = who[at], row[at]
            for c, v in (("anchor_id", anchors["vec_id"][has[who]]), ("positive_id", pid[who]),
                         ("positive_score", top[who]), ("vec_id", rows["vec_id"][row]), ("score", part[who, row])):
                out[c].append(v)
        return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
    return pick


def _by_length(batches: list[pa.RecordBatch]) -> dict[int, dict]:
    """Rows as arrays, one set per length of vector."""
    table = pa.Table.from_batches(batches).combine_chunks()
    size = pc.list_value_length(table["v"]).to_numpy()
    out = {}
    for d in np.unique(size).tolist():
        rows = table.filter(pa.array(size == d))
        v = pc.list_flatten(rows["v"]).to_numpy().astype(np.float64).reshape(len(rows), d)
        out[d] = {"vec_id": rows["vec_id"].to_numpy(), "label": rows["label"].to_numpy(), "block": Block(v),
                  "positives": [[(p["id"], p["score"]) for p in ps or []] for ps in rows["positives"].to_pylist()]}
    return out


def _scan(anchors: DataFrame, rows: DataFrame, blocks: int, pick: Pick) -> DataFrame:
    """Score every anchor against every block of rows; ``pick`` chooses what a block returns."""
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                          "vec_id", "label", "v", "positives")
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    held = rows.select("block", F.lit(0).alias("kind"), "vec_id", "label", "v", none)

    def scored(pack: pa.RecordBatch, known: dict[int, dict]) -> Iterator[pa.RecordBatch]:
        for d, a in _by_length([pack]).items():
            if d in known:
                got = pick(scores(a["block"], known[d]["block"]), a, known[d])
                if len(got["vec_id"]):
                    yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in got.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known = None, [], {}
        for batch in batches:
            block, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edge = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(block)].tolist()):
                if hi == lo:
                    continue
                if block[lo] != at:
                    at, held, known = block[lo], [], {}
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if held:   # the block is complete: its rows sort before the anchors
                    held, known = [], _by_length(held)
                for i in range(lo, hi, PACK):
                    yield from scored(batch.slice(i, min(PACK, hi - i)), known)

    both = held.unionAll(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, _SCORED)


def labelled_vectors(rows: DataFrame, scale: float, vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): rows that take part, each component x as floor(scale * x), one row per id."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    one = kept.select(F.col("vec_id").cast("long").alias("vec_id"),
                      F.struct((F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("v")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80,
         block_rows: int = 32_768, least_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` as ``labelled_vectors`` returns them; ``anchors`` tells which rows are anchors.  Per anchor
    the first ``positives`` other rows of its label, and for each the first ``negatives`` rows of other
    labels whose score is at least ``percent`` hundredths of the positive's and not above it.  Every block
    receives every anchor, so blocks are as large as a task's memory allows (``block_rows``), and smaller,
    down to ``least_rows``, only while there are fewer of them than shuffle partitions.
    """
    vectors = materialize(vectors, name="vectors")
    n, tasks = max(1, vectors.count()), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // block_rows), min(tasks, -(-n // least_rows)))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    chosen = vectors.filter(anchors)
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = _scan(chosen.withColumn("positives", none), rows, blocks, _positives(positives)) \
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    found = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("positives"))
    asked = materialize(chosen.join(found, chosen["vec_id"] == found["anchor_id"]).drop("anchor_id"), name="anchors")
    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return _scan(asked, rows, blocks, _negatives(negatives, percent)) \
        .withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
