"""Centroid clustering, hard negatives and k-d sharding against plain Python versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from supplyrisk.llm import centroids, hard_negatives, kd_shards, queries
from supplyrisk.plans import has_python_udf

from ..conftest import SF_CHECK, SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int"


def _rows(sf):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _f32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if _finite(v) and len(v) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, _sha(f"1:{r[0]}"), r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centers)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, dist, n in out:
        inertia[n] += dist
    return sorted(((i, n, dist, inertia[n], sum(inertia.values()), _sha(",".join(map(str, centers[n])))) for i, dist, n in out), key=str)


def _clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                               "centroid_sha256").collect()), key=str)


def test_column_types_of_the_queries(spark):
    assert dict(queries.op11_centroids(spark, SF_SMALL).dtypes) == {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert dict(queries.op13_hard_negatives(spark, SF_SMALL).dtypes) == {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_centroids_of_the_whole_table(spark):
    assert _clusters(queries.op11_centroids(spark, SF_CHECK)) == brute_clusters(_rows(SF_CHECK))


def test_centroids_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i % 37, [rng.choice([-0.5, -0.01, 0.0, 0.3]) for _ in range(4)], 1) for i in range(60)]
    rows += [(None, [0.1] * 4, 1), (90, None, 1), (91, [0.1, None, 0.2, 0.3], 1), (92, [float("nan")] * 4, 1),
             (93, [float("inf")] * 4, 1), (94, [0.1] * 3, 1), (95, [], None), (1, [0.1] * 4, None)]
    rows = [(i, _f32(v), x) for i, v, x in rows]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit("clash"), "cluster": F.lit(3), "distance": F.lit(9)})
    got = _clusters(centroids.report(centroids.integer_vectors(df, 64, 4)))
    assert got == brute_clusters(rows, dims=4)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert _clusters(centroids.report(centroids.integer_vectors(few, 64, 4))) == brute_clusters(rows[:3], dims=4)
    assert _clusters(centroids.report(centroids.integer_vectors(df.limit(0), 64, 4))) == []


def test_search_rejects_nothing_it_needs():
    rng = np.random.default_rng(3)
    for spread in (1, 3, 40, 2**20):
        x, c = rng.integers(-spread, spread + 1, (500, 8)), rng.integers(-spread, spread + 1, (23, 8))
        every = ((x[:, None] - c) ** 2).sum(2)
        number, distance = centroids.nearest(x, c)
        assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 4, 1), (2, [0.0] * 4, 1)], VECTORS)
    with pytest.raises(Exception, match="would not fit"):
        centroids.report(centroids.integer_vectors(df, 64, 4)).collect()


def brute_negatives(rows, every=100):
    rows = sorted({r[0]: r for r in sorted(((i, x, [math.floor(256 * c) for c in v]) for i, v, x in rows
                                             if i is not None and x is not None and _finite(v)), reverse=True)}.values())
    rows = [(i, (x + 1) % 10 if i % 7 == 0 else x, v) for i, x, v in rows]
    out = []
    for i, x, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, y) for j, y, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == x][:5]:
            window = [(n, m) for n, m, y in scored if y != x and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(i, j, rank, m, -s, -n) for rank, (n, m) in enumerate(window, 1)]
    return sorted(out)


def _mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_negatives_of_the_whole_table(spark, sf):
    got = _mined(queries.op13_hard_negatives(spark, sf))
    assert got == brute_negatives(_rows(sf)) and got


def test_negatives_of_odd_rows_in_many_blocks(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.5, 0.25, 0.0, -0.1]) for _ in range(5)], rng.randint(0, 2)) for i in range(160)]   # many ties
    rows += [(None, [0.1] * 5, 1), (200, None, 1), (210, [0.1, None, 0.2, 0.3, 0.1], 1), (220, [float("nan")] * 5, 1), (230, [0.5] * 5, None),
             (240, [0.5] * 3, 1), (250, [0.25] * 3, 1), (253, [0.5, 0.5, 0.25], 2), (260, [], 1), (261, [], 2), *[(10, [0.5] * 5, 0)] * 3]
    rows = [(i, _f32(v), x) for i, v, x in rows]
    rows += [(300, _f32([3e5, -2e5, 1e5, 4e5, 7.0]), 1), (301, _f32([3e5, -2e5, 1e5, 4e5, 7.0]), 1), (302, _f32([3e5, -2e5, 1e5, 3.9e5, 7.0]), 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"block": F.lit(1), "kind": F.lit("x"), "v": F.lit(0), "r": F.lit(0)})
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(df, 256, label=moved)
    got = _mined(hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, block_rows=20))
    assert got == brute_negatives(rows, every=10)
    assert _mined(hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 10 == 0)) == []


@pytest.mark.parametrize("top,dims", [(1, 3), (200, 64), (10**6, 64), (2**28, 20), (50, 3000)])
def test_residue_products_are_exact(top, dims):
    rng = np.random.default_rng(top)
    a, b = rng.integers(-top, top + 1, (7, dims)), rng.integers(-top, top + 1, (9, dims))
    got = hard_negatives.scores(hard_negatives.Block(a.astype(float)), hard_negatives.Block(b.astype(float)))
    assert (got == a @ b.T).all()


def test_scores_beyond_the_range_raise():
    big = hard_negatives.Block(np.full((1, 4), 2.0**40))
    with pytest.raises(ValueError, match="2\\^62"):
        hard_negatives.scores(big, big)


def _shards(df):
    return [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]


def _check_shards(rows, docs, shards):
    """Every document once, with its size and crc; slots gapless; no shard off by more than the largest document."""
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    assert sorted((r[:3] for r in rows), key=str) == want
    by = collections.defaultdict(list)
    for r in rows:
        assert r[3] == "bytes" and r[6] is None and 0 <= r[4] < shards
        by[r[4]].append(r)
    for part in by.values():
        assert sorted(r[5] for r in part) == list(range(len(part)))
    if rows:
        total, most = sum(r[1] for r in rows), max(r[1] for r in rows)
        for s in range(shards):
            assert abs(sum(r[1] for r in by[s]) - total / shards) <= most


def test_shards_of_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF_CHECK}/documents.parquet").to_pylist()]
    df = queries.op12_sharding(spark, SF_CHECK)
    assert not has_python_udf(df)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
                               "grown_shard": "int"}
    _check_shards(_shards(df), docs, 40)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_shards_of_odd_rows(spark):
    rng = random.Random(6)
    docs = [(i, "ä" * rng.randint(0, 40), rng.choice(["en", None, "de"]), rng.choice(["src0", "src0", "src1", None, ""]), rng.choice([None, 5, i]))
            for i in range(200)]
    docs += [(7, "same text here", "en", "src0", 5)] * 150 + [(None, None, None, None, None)] * 60
    docs += [(2**63 - 1, "x", "en", "zz", 2**62), (-2**63, "y", "en", "aa", -2**62)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("node", "size", "key", "uid", "k0", "shard")})
    _check_shards(_shards(kd_shards.shard(df, shards=7)), [d[:2] for d in docs], 7)
    alike = spark.createDataFrame([(1, "all the same", "en", "s", 3)] * 90, DOCS).repartition(3)
    _check_shards(_shards(kd_shards.shard(alike, shards=8)), [(1, "all the same")] * 90, 8)
    few = spark.createDataFrame(docs[:3], DOCS)
    _check_shards(_shards(kd_shards.shard(few, shards=40)), [d[:2] for d in docs[:3]], 40)
    assert _shards(kd_shards.shard(df.limit(0))) == []


def test_long_texts_and_target_bytes(spark):
    docs = [(i, "word " * (40_000 if i == 3 else 100), "en", f"s{i % 5}", i) for i in range(400)]
    df = spark.createDataFrame(docs, DOCS)
    rows = _shards(kd_shards.shard(df, target_bytes=60_000))
    shards = -(-sum(r[1] for r in rows) // 60_000)
    _check_shards(rows, [d[:2] for d in docs], shards)


def test_cuts_follow_the_widest_dimension(spark):
    """Two far-apart sources of equal bytes part at the first cut: no shard holds both."""
    docs = [(i, "t" * 50, "en", "aaa" if i % 2 else "zzz", 7) for i in range(80)]
    rows = _shards(kd_shards.shard(spark.createDataFrame(docs, DOCS), shards=4))
    source = {d[0]: d[3] for d in docs}
    assert all(len({source[r[0]] for r in rows if r[4] == s}) == 1 for s in range(4))


def test_shard_files_hold_the_documents(spark, tmp_path):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    folder = kd_shards.write_shards(df, str(tmp_path / "shards"), shards=5)
    back = spark.read.parquet(folder)
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == df.count()
    sizes = [r["b"] for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("b")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2 * df.agg(F.max(F.octet_length("text"))).first()[0]
