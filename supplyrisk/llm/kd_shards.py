"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A node of the tree holds a range of shards.  It is cut along its widest
metadata dimension (extent relative to the whole table's) at the weighted
median, or, for an odd number of shards, at the weighted quantile that
gives each side its share of bytes, until every leaf is one shard of about
the target bytes.

The cut of every node of a level is found together, by refining
histograms: an aggregate of bytes per (node, bin), summed on the map side,
names the bin that holds the cut, and the next pass divides that bin.  No
row is shuffled for it and nothing depends on how often a value occurs:
among rows of the cut's value the document id decides, and among rows of
one id the row's place in the written table.  The driver holds one cut per
node of a level, and so at most one number per shard; rows learn their node
by comparison with its cut.

Law ``bytes``: every cut falls within half a document of its share, so a
shard differs from the target by less than the largest document.

Defined cases: null text is empty (16 bytes of size), null numbers count
as 0 and null strings as empty, null ids sort first; strings are ordered by
their first six bytes; repeated rows are documents of their own; with fewer
documents than shards some shards stay empty; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyrisk.functions.stats import prefix_sums
from supplyrisk.plans import materialize

DIMENSIONS = ("n_chars", "source", "lang")
OVERHEAD = 16
BINS = 65_536        # bins of one pass, shared by its nodes
NO_ID = -(1 << 63)   # a null doc_id


def dimension_key(column: str, kind: T.DataType) -> Column:
    """A metadata column as a number whose order is the column's."""
    c = F.col(column)
    if isinstance(kind, T.IntegralType):
        key = c.cast("long")
    elif isinstance(kind, T.DateType):
        key = F.unix_date(c).cast("long")
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(c)
    elif isinstance(kind, T.StringType):
        key = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("long")
    else:
        raise ValueError(f"no order for dimension {column} of type {kind.simpleString()}")
    return F.coalesce(key, F.lit(0).cast("long"))


def narrow(docs: DataFrame, dimensions=DIMENSIONS, uid: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, uid, k0, k1, ...): what the tree needs of a document, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                      (F.monotonically_increasing_id() if uid is None else uid).alias("uid"),
                      *[dimension_key(d, kinds[d]).alias(f"k{i}") for i, d in enumerate(dimensions)])
    return materialize(out, name="documents-narrow")


class Node:
    """A leaf, open or done: ``shards`` shards from ``first`` on, which is also its number."""

    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards


class Cut:
    """The cut of a node under way: rows up to (value, doc_id, uid) go left."""

    def __init__(self, node: Node, dim: int, lo: int, hi: int, target: int):
        self.node, self.dim, self.lo, self.hi, self.target = node, dim, lo, hi, target
        self.before = 0     # bytes before the range lo..hi of the stage's key
        self.upto: list[int] = []
        self.last = 0       # bytes of the rows at ``upto``


def _ident() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID))


def _at_node(values: dict[int, int]) -> Column:
    """The value of a row's node (0 for a node without one), from an array literal by node number."""
    size = max(values, default=0) + 1
    text = ",".join(str(int(values.get(i, 0))) for i in range(size))
    return F.coalesce(F.get(F.split(F.lit(text), ",").cast("array<long>"), F.col("node")), F.lit(0).cast("long"))


def _key(stage: int, cuts: list[Cut]) -> Column:
    """The stage's key of a row: the dimension its node is cut along, doc_id, then uid."""
    if stage:
        return _ident() if stage == 1 else F.col("uid")
    used = sorted({c.dim for c in cuts})
    dim = _at_node({c.node.first: c.dim for c in cuts})
    return F.coalesce(*[F.when(dim == d, F.col(f"k{d}")) for d in used])


def _refine(rows: DataFrame, cuts: list[Cut], stage: int) -> None:
    """Find, for every cut, the value of the stage's key where its share of bytes ends."""
    active = cuts
    while active:
        by = {c.node.first: c for c in active}
        bins = max(1024, BINS // len(active))
        shift = {n: max(0, (c.hi - c.lo).bit_length() + 1 - bins.bit_length()) for n, c in by.items()}
        found = rows.filter(_at_node({n: 1 for n in by}) == 1)
        for s in range(stage):
            found = found.filter(_key(s, active) == _at_node({n: c.upto[s] for n, c in by.items()}))
        found = found.select("node", "size", _key(stage, active).alias("key"), _key(min(stage + 1, 2), active).alias("next"),
                             _at_node(shift).cast("int").alias("shift")) \
            .filter(F.col("key").between(_at_node({n: c.lo for n, c in by.items()}), _at_node({n: c.hi for n, c in by.items()})))
        hist = found.groupBy("node", F.expr("shiftright(key, shift)").alias("bin")).agg(
            F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"),
            F.min("next").alias("next_lo"), F.max("next").alias("next_hi"))
        # at most two times ``bins`` rows a node
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        rest = _at_node({n: c.target - c.before for n, c in by.items()})
        at = hist.withColumn("upto", upto).filter((F.col("upto") >= rest) & (F.col("upto") - F.col("w") < rest)).collect()
        for r in at:   # one row a node
            c = by[r["node"]]
            c.before += r["upto"] - r["w"]
            c.lo, c.hi, c.last = r["lo"], r["hi"], r["w"]
            if c.lo == c.hi:
                c.upto.append(c.lo)
                c.lo, c.hi = r["next_lo"], r["next_hi"]
                del by[r["node"]]
        active = list(by.values())


def _divided(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Rows with the number of the child node they fall into, written for the passes of the next level."""
    inclusive = {c.node.first: 2 * (c.target - c.before) > c.last for c in cuts}
    value, doc, uid = (_at_node({c.node.first: c.upto[s] for c in cuts}) for s in range(3))
    key, ident = _key(0, cuts), _ident()
    at_last = (F.col("uid") < uid) | ((F.col("uid") == uid) & (_at_node(inclusive) == 1))
    left = (key < value) | ((key == value) & ((ident < doc) | ((ident == doc) & at_last)))
    right = _at_node({c.node.first: c.node.first + c.node.shards // 2 for c in cuts})
    moved = F.when(_at_node({c.node.first: 1 for c in cuts}) == 0, F.col("node")).when(left, F.col("node")).otherwise(right)
    return materialize(rows.withColumn("node", moved.cast("int")), name="nodes")


def grow(rows: DataFrame, dims: int, shards: int = 40, target_bytes: int | None = None) -> DataFrame:
    """``narrow`` rows with ``node``, the number of their leaf: ``shards`` leaves, or as many as
    ``target_bytes`` asks for."""
    rows, nodes, extent = rows.withColumn("node", F.lit(0)), [], None
    ends = [f(f"k{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    while True:
        boxes = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}   # a row a node
        if not boxes:
            return rows
        if extent is None:
            extent = [max(1, boxes[0][f"hi{i}"] - boxes[0][f"lo{i}"]) for i in range(dims)]
            nodes = [Node(0, max(1, -(-boxes[0]["w"] // target_bytes)) if target_bytes else shards)]
        cuts = []
        for x in nodes:
            if x.shards > 1 and (box := boxes.get(x.first)) is not None:   # a node without documents stays as it is
                wide = max(range(dims), key=lambda i: (box[f"hi{i}"] - box[f"lo{i}"]) / extent[i])
                target = max(1, round(box["w"] * (x.shards // 2) / x.shards))
                cuts.append(Cut(x, wide, box[f"lo{wide}"], box[f"hi{wide}"], target))
        if not cuts:
            return rows
        for stage in range(3):
            _refine(rows, cuts, stage)
        rows = _divided(rows, cuts)
        split = {c.node.first for c in cuts}
        nodes = [y for x in nodes for y in ([Node(x.first, x.shards // 2), Node(x.first + x.shards // 2, x.shards - x.shards // 2)]
                                            if x.first in split else [x])]


def shard(docs: DataFrame, dimensions=DIMENSIONS, shards: int = 40, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    placed = grow(narrow(docs, dimensions), len(dimensions), shards, target_bytes) \
        .select("doc_id", "size", "text_crc32", "uid", F.col("node").alias("shard"))
    slots = prefix_sums(placed, "uid", [], rank_col="slot", partition_by=["shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, dimensions=DIMENSIONS, shards: int = 40,
                 target_bytes: int | None = None) -> str:
    """The documents themselves as Parquet under ``folder``, one subfolder ``shard=N`` each.

    ``docs`` is written once with the rows' places, so that the tree and the files see the same rows;
    the texts move once more, to the node-numbered rows of their place.
    """
    held = materialize(docs.withColumn("uid", F.monotonically_increasing_id()), name="documents-held")
    placed = grow(narrow(held, dimensions, uid=F.col("uid")), len(dimensions), shards, target_bytes)
    held.join(placed.select("uid", F.col("node").alias("shard")), "uid").drop("uid") \
        .write.mode("overwrite").partitionBy("shard").parquet(folder)
    return folder
