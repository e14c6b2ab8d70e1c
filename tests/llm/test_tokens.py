"""Encoders, bin completion, packing, token files."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from supplyrisk.llm import encoders, packing, queries, token_files
from supplyrisk.llm.bin_completion import best_fit, bin_count, fillings, pack_counts
from supplyrisk.llm.encoders import Encoder

from ..conftest import SF_SMALL

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_encoder_equals_the_tokenizer(kind):
    enc = Encoder(public_tokenizers.path(FILES[kind]), kind)
    rng = random.Random(1)
    letters = " \n\t  aZ9'sÉéßÿªµº²ſΣσİ́ ​\x1c\x85\0.,<|endoftext|>ñ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["it's I'LL we've <|endoftext|> x", "  a   b  ", "\n\n x\n \ny ", " \nfoo  ", "'sé DON'T 'S", ""]
    for t in texts:
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, repr(t)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_long_texts_are_cut_where_the_splitter_cuts(kind, monkeypatch):
    monkeypatch.setattr(encoders, "STRETCH", 40)
    monkeypatch.setattr(encoders, "CACHE_LIMIT", 50)
    enc = Encoder(public_tokenizers.path(FILES[kind]), kind)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "It's ", "\n", "  ", "é", "9 8", "\t", ".", " x", "ñ ", "DON'T", "²"]) for _ in range(rng.randint(1, 120)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_must_fit_the_file_type(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write_token_files(docs, str(tmp_path), public_tokenizers.path(FILES["byte"]), dtype="<u1")


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_added_tokens_are_read_as_by_the_library(kind):
    path = public_tokenizers.path(FILES[kind])
    enc, fresh = Encoder(path, kind), Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "a", "It's", "É", "9"]
    texts = ["a <|endoftext|> b", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(500))]
    for t in texts:
        want = fresh.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, repr(t)
    if kind == "byte":
        assert np.frombuffer(enc.encode(texts[0]), "<u4").tolist() == [64, 220, 50256, 275]


def _valid(solution, counts, capacity):
    used = collections.Counter()
    for filling, times in solution:
        assert times > 0 and sum(x * n for x, n in filling) <= capacity
        for x, n in filling:
            used[x] += n * times
    assert used == collections.Counter({x: n for x, n in counts.items() if n})


def _optimal(counts, capacity):
    items = tuple(sorted((x for x, n in counts.items() for _ in range(n)), reverse=True))
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, rest + [r - items[i]])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randint(8, 30)
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 9)))
        solution = pack_counts(dict(counts), capacity)
        _valid(solution, counts, capacity)
        assert bin_count(solution) == _optimal(counts, capacity), (capacity, counts)


def test_bin_completion_is_optimal_on_twenty_items():
    """Item counts where best fit and the narrow rounds leave a bin too many."""
    rng = random.Random(9)
    harder = 0
    for _ in range(60):
        capacity = rng.choice([20, 50, 100])
        counts = collections.Counter(rng.randint(capacity // 7, capacity // 2) for _ in range(rng.randint(15, 20)))
        solution = pack_counts(dict(counts), capacity)
        _valid(solution, counts, capacity)
        assert bin_count(solution) == _optimal(counts, capacity), (capacity, counts)
        harder += bin_count(best_fit(dict(counts), capacity)) > bin_count(solution)
    assert harder


def test_all_undominated_fillings():
    left = np.zeros(11, int)
    left[[9, 4, 3]] = [1, 1, 2]
    assert fillings(10, left, 10) == [(0, {4: 1, 3: 2})]
    assert fillings(10, left, 10, keep=None) == [(0, {4: 1, 3: 2}), (1, {9: 1})]   # a long item has no substitute


def test_bin_completion_beats_best_fit():
    counts = {7: 2, 6: 2, 5: 2, 4: 2, 3: 4}   # volume 56
    assert bin_count(pack_counts(counts, 14)) == 4
    left = np.zeros(9, int)
    left[[5, 4, 3, 1]] = [1, 1, 2, 1]
    assert fillings(8, left, 8) == [(0, {5: 1, 3: 1}), (0, {4: 1, 3: 1, 1: 1})]
    assert _valid(best_fit({3: 1000, 5: 1000}, 8), {3: 1000, 5: 1000}, 8) is None


def test_large_counts_are_fast_and_near_the_bound():
    rng = random.Random(6)
    counts = collections.Counter()
    for _ in range(1500):
        counts[rng.randint(1, 2047)] += rng.randint(1, 10 ** 7)
    solution = pack_counts(dict(counts), 2048)
    _valid(solution, counts, 2048)
    bound = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert bin_count(solution) <= 1.02 * max(bound, sum(n for x, n in counts.items() if x > 1024))


def _check_packing(rows, docs, capacity):
    enc = Encoder(public_tokenizers.path(FILES["word"]), "word")
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = collections.defaultdict(list)
    for d, t in docs:
        ids = enc.encode(t or "") + bytes(4)
        want[d] += [(i, a // 4, len(ids[a:a + 4 * capacity]) // 4, zlib.crc32(ids[a:a + 4 * capacity]))
                    for i, a in enumerate(range(0, len(ids), 4 * capacity))]
    assert {d: sorted(v) for d, v in by.items()} == {d: sorted(v) for d, v in want.items()}
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_odd_rows(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["word"] * rng.randint(0, 80))) for i in range(300)]
    docs += [(500 + i, "same length here") for i in range(200)] + [(900, None), (901, ""), (901, ""), (None, "x " * 100)]
    table = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, piece int").repartition(3)
    rows = packing.pack(table, public_tokenizers.path(FILES["word"]), capacity=32).collect()
    n = _check_packing(rows, docs, 32)
    assert n <= 1.02 * sum(r.length for r in rows) / 32 + 2
    assert packing.pack(table.limit(0), public_tokenizers.path(FILES["word"])).count() == 0


def test_packing_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()]
    rows = queries.op2_packing(spark, SF_SMALL).collect()
    n = _check_packing(rows, docs, 2048)
    assert n == -(-sum(r.length for r in rows) // 2048)


def _check_files(rows, docs):
    enc = Encoder(public_tokenizers.path(FILES["byte"]), "byte")
    start = 0
    want = []
    for d, t in docs:
        ids = enc.encode(t or "") + bytes(4)
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(rows, key=lambda r: r[1]) == want


def test_token_files_round_trip(spark, tmp_path):
    docs = [(None, "null id"), *((i, "text %d é" % i if i % 7 else None) for i in range(-5, 400))]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_ids int").repartition(5)
    vocabulary = public_tokenizers.path(FILES["byte"])
    out = token_files.round_trip(spark, table, str(tmp_path / "ids"), vocabulary).collect()
    _check_files([tuple(r) for r in out], docs)
    files = sorted((tmp_path / "ids").iterdir())
    assert {f.suffix for f in files} == {".bin", ".idx"}
    # the format: flat uint16 ids, then doc_ids and 64-bit offsets
    n = sum(np.memmap(f, "<u2", "r").size for f in files if f.suffix == ".bin")
    assert n == sum(r.n_tokens for r in out)
    empty = token_files.round_trip(spark, table.limit(0), str(tmp_path / "none"), vocabulary)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        token_files.shared_folder("hdfs://store/x")


def test_token_file_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist())
    _check_files([tuple(r) for r in queries.op7_token_files(spark, SF_SMALL).collect()], docs)
