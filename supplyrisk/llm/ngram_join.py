"""Jaccard self-join on word five-grams with several global token orders.

Two sets with Jaccard similarity of at least ``threshold`` share a token
among the first ``n - ceil(threshold * n) + 1`` tokens of each, under any
global order of tokens.  Several orders are used, all rarest first (by the
number of texts that hold a token) and different in the order of equally
rare tokens: a candidate pair must share a prefix token under every one
of them before its similarity is computed exactly.

Steps, each one Spark job on tables in the shared folder:

1. every text becomes the set of its shingle hashes; texts with equal sets
   form a class, and only classes take part further on;
2. ``shared.shared_values`` finds the tokens that two classes or more
   hold.  A token of one class alone comes first in every order and cannot
   be shared, so most classes have no candidates at all;
3. pivot rounds: in each group of classes that share a prefix token, every
   class is compared with one pivot, and links are merged into components.
   Groups of near copies collapse without comparing all pairs;
4. all pairs left, those that share a prefix token, still lie in different
   components and can reach the similarity by their sizes and the places of
   the token, are compared.  No link between components is lost, and a pair
   inside a component could not change the result.

Defined cases: words are split at ASCII white space with A-Z folded; a text
of one to four words is one shingle of them all; texts without words, and
null texts, have the empty set and link with nothing; repeated rows fall
into one class, rows of one id and several texts into several; a null id
takes the component of its equal texts and links nothing by itself; an empty
table gives an empty result; very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.components import components
from supplyrisk.llm.shared import _KEY, shared_values
from supplyrisk.llm.shingles import ASCII_SPACE, byte_table, chunks, mix, shingles, utf8, word_hashes
from supplyrisk.plans import materialize

_TABLE = byte_table(ASCII_SPACE)
ORDERS = 3


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, index of their text, class keys): texts with equal sets have equal keys."""
    hashes, owner = word_hashes(texts, _TABLE)
    value, who, _ = shingles(hashes, owner, len(texts), width)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    first = np.r_[True, (value[1:] != value[:-1]) | (who[1:] != who[:-1])] if len(value) else np.zeros(0, bool)
    value, who = value[first], who[first]
    keys = np.zeros(len(texts), _KEY)
    sizes = np.bincount(who, minlength=len(texts))
    # order-free 128-bit signature of a set: two independent sums of mixed hashes
    has = np.flatnonzero(sizes)
    if len(has):
        starts = np.concatenate([[0], np.cumsum(sizes)])[has]
        keys["hi"][has] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
        keys["lo"][has] = np.add.reduceat(mix(value + np.uint64(0x14057B7EF767814F)), starts)
    return value, who, keys


def set_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, h, n, hi, lo): size and signature of every document's set; ``h`` tells texts of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts):
                _, who, keys = shingle_sets(texts[lo:hi])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(lo, hi - lo), "h": batch.column(2).slice(lo, hi - lo),
                    "n": pa.array(np.bincount(who, minlength=hi - lo)),
                    "hi": pa.array(keys["hi"].view("<i8")), "lo": pa.array(keys["lo"].view("<i8"))})
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return docs.mapInArrow(run, "doc_id long, h long, n long, hi long, lo long")


def with_prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """Classes that can have partners: shared tokens and the shared part of their prefix under each order."""
    schema = "rep long, n long, own long, tokens array<long>, " + ", ".join(f"p{k} array<long>" for k in range(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("rep", "n", "own", "tokens", *(f"p{k}" for k in range(ORDERS)))}
            for r in batch.to_pylist():
                tokens, df, n = np.frombuffer(r["vals"], "<u8"), np.frombuffer(r["df"], "<u2"), r["n"]
                prefix = n - -(-n * percent // 100) + 1
                own = n - len(tokens)   # the class's own tokens fill the front
                room = prefix - own
                if room <= 0:
                    continue
                for c, v in (("rep", r["rep"]), ("n", n), ("own", own), ("tokens", tokens.astype(np.int64))):
                    out[c].append(v)
                for k in range(ORDERS):
                    order = np.lexsort((mix(tokens + np.uint64(k)), df))
                    out[f"p{k}"].append(tokens[order[:room]].astype(np.int64))
            lists = {c: pa.array(out[c], pa.list_(pa.int64())) for c in out if c not in ("rep", "n", "own")}
            yield pa.RecordBatch.from_pydict({**{c: pa.array(out[c], pa.int64()) for c in ("rep", "n", "own")}, **lists})

    return shared.mapInArrow(run, schema)


def _can_link(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """Can sets of these sizes reach the similarity when the first token they share, in the first order,
    stands at these places?  The tokens before it are not shared, which bounds the intersection."""
    most = F.least(n_a - at_a, n_b - at_b)
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a) & ((100 + percent) * most >= percent * (n_a + n_b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets share a prefix token under every order and reach the similarity."""
    cols = ["n", "tokens", *(f"p{k}" for k in range(1, ORDERS))]
    left = sets.select(F.col("rep").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = sets.select(F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = pairs.join(left, "a").join(right, "b")
    for k in range(1, ORDERS):
        both = both.filter(F.arrays_overlap(f"a_p{k}", f"b_p{k}"))
    same = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.withColumn("same", same) \
        .filter(100 * F.col("same") >= percent * (F.col("a_n") + F.col("b_n") - F.col("same"))).select("a", "b")


def class_links(sets: DataFrame, percent: int, pivot_rounds: int = 3) -> DataFrame:
    """(id, component_id) of the classes that have a link, ``sets`` being a written table with ``rep``."""
    spark = sets.sparkSession
    prefix = sets.select("rep", "n", "own", F.posexplode("p0").alias("place", "token"))
    prefix = materialize(prefix.select("rep", "n", (F.col("own") + F.col("place")).alias("at"), "token"), name="prefix")
    links = spark.createDataFrame([], "a long, b long")
    members, label = prefix.withColumn("c", F.col("rep")), F.col("c")
    for r in range(pivot_rounds):
        pick = F.min(F.struct(F.xxhash64(F.col("rep"), F.lit(r)).alias("h") if r else F.col("rep").alias("h"),
                              F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("c").alias("c_a")))
        pivots = members.groupBy("token").agg(pick.alias("p"), F.count_distinct(label).alias("k")) \
                        .filter("k > 1").select("token", "p.*")
        pairs = members.join(pivots, "token").filter(
            (F.col("c") != F.col("c_a")) & _can_link(F.col("n"), F.col("at"), F.col("n_a"), F.col("at_a"), percent)) \
                       .select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b")).distinct()
        links = materialize(links.unionAll(verified(pairs, sets, percent)).distinct(), name="links")
        comps = materialize(components(links), name="components")
        members = _labelled(prefix, comps)
    left = members.select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("c").alias("c_a"))
    right = members.select("token", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("c").alias("c_b"))
    rest = left.join(right, "token").filter(
        (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b"))
        & _can_link(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent)).select("a", "b").distinct()
    return components(links.unionAll(verified(rest, sets, percent)))


def _labelled(prefix: DataFrame, comps: DataFrame) -> DataFrame:
    """Prefix rows with their component, without the groups that lie in one component."""
    rows = prefix.join(comps, prefix["rep"] == comps["id"], "left") \
                 .select("token", "rep", "n", "at", F.coalesce("component_id", "rep").alias("c"))
    open_groups = rows.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1")
    return materialize(rows.join(open_groups.select("token"), "token"), name="members")


def row_components(documents: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, h, n, root, component_id) of every row: ``h`` is the text's hash, ``root`` the number of its
    component (null without words or id), ``component_id`` the smallest doc_id in it."""
    classes = materialize(set_classes(documents), name="classes")
    reps = classes.filter("n > 0 and doc_id is not null").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc"))
    # a class goes by its smallest id, so that an original is the first pivot of its copies; of an id's
    # several texts one does, the others by a hash of their set
    several = reps.groupBy("doc").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("hi", "lo")).alias("f")).filter("k > 1").drop("k")
    own = F.col("f").isNull() | (F.struct("hi", "lo") == F.col("f"))
    reps = reps.join(several, "doc", "left").withColumn("rep", F.when(own, F.col("doc")).otherwise(F.xxhash64("hi", "lo"))).drop("f")
    reps = materialize(reps, name="reps")
    shared = shared_values(documents, shingle_sets)
    sets = with_prefixes(shared.join(reps.drop("doc"), ["hi", "lo"]), percent)
    comps = materialize(class_links(materialize(sets, name="sets"), percent), name="linked") \
        .select(F.col("id").alias("rep"), F.col("component_id").alias("root"))
    smallest = reps.join(comps, "rep").groupBy("root").agg(F.min("doc").alias("component_id"))
    named = reps.join(comps.join(smallest, "root"), "rep", "left") \
                .select("hi", "lo", "n", F.coalesce("root", "rep").alias("root"), F.coalesce("component_id", "doc").alias("component_id"))
    return classes.join(named, ["hi", "lo", "n"], "left").select(
        "doc_id", "h", "n", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_components(documents: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable by links."""
    return row_components(documents, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one document stays, the one with the smallest (doc_id, text hash).

    Rows are judged one by one, so an id with two texts loses only the text that is a copy; of equal rows of
    that document one stays.  Rows without a word or with a null id are linked with nothing and stay.
    """
    rows = materialize(row_components(docs).filter("n > 0 and doc_id is not null"), name="row-components")
    here = F.struct("doc_id", "h")
    first = rows.groupBy("root").agg(F.min(here).alias("first"))
    lost = rows.join(first, "root").filter(here != F.col("first")).select("doc_id", "h").distinct()
    again = materialize(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
                            .join(lost, ["doc_id", "h"], "left_anti").select("doc_id", "h"), name="equal-rows")
    hashed = docs.withColumn("h", F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(lost, ["doc_id", "h"], "left_anti")
    # equal rows are few: only they are shuffled to keep one of them
    one = kept.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return kept.join(again, ["doc_id", "h"], "left_anti").unionByName(one).select("doc_id", "text", "lang", "source", "n_chars")
