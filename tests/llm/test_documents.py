"""N-gram join, decontamination, suffix dedup, components: against brute force on odd rows and the table."""

import collections
import math
import random
from os.path import commonprefix

import numpy as np
import pyarrow.parquet as pq
import pytest

from supplyrisk.llm import decontam, ngram_join, queries, suffix_dedup
from supplyrisk.llm.components import components

from ..conftest import SF_SMALL
from . import brute


def _words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def copies():
    """Near copies in chains and stars, exact copies, shared passages, short and empty texts."""
    rng = random.Random(11)
    rows = []
    common = " ".join(_words(rng, 60))
    for _ in range(25):
        rows.append(" ".join(_words(rng, rng.randint(20, 120))) + "\n" + common)
    for _ in range(6):
        base = _words(rng, rng.randint(80, 150))
        for _ in range(12):   # each a change of the one before: a chain
            base = list(base)
            base[rng.randrange(len(base))] = "changed"
            rows.append(" ".join(base))
    rows += ["Same text HERE twice over"] * 3 + ["same  text here\ttwice over"] + ["one two three"] * 2 + ["one two", "", None, " \n"]
    rows += [common, common.upper(), common + " tail"] * 2
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def _table(spark, rows):
    return spark.createDataFrame([(d, t, 3, "s") for d, t in rows], "doc_id long, text string, n long, vals string").repartition(4)


def test_join_components(spark, copies):
    sets = {d: brute.shingle_set(t or "") for d, t in copies}
    want = brute.components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(_table(spark, copies)).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_dedup_stage_keeps_one_of_each_group(spark, copies):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in [*copies, (None, "null id")]],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    want = {d for d, c in brute.components({d: brute.shingle_set(t or "") for d, t in copies}).items() if d == c}
    out = ngram_join.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == want | {None}


def test_join_of_nothing(spark):
    assert ngram_join.join_components(_table(spark, [(1, "a b c d e f")]).limit(0)).count() == 0
    one = ngram_join.join_components(_table(spark, [(1, None), (2, ""), (3, "a b")])).collect()
    assert sorted(map(tuple, one)) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(5, x) for x in range(10, 40)] + [(7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{x: 100 for x in path}, 5: 5, **{x: 5 for x in range(10, 40)}}


def test_join_query(spark):
    sets = {r["doc_id"]: brute.shingle_set(r["text"] or "") for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()}
    want = brute.components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_join(spark, SF_SMALL).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, " ".join(_words(rng, rng.randint(12, 40))) + ".") for i in range(12)] + [(90, None), (91, ""), (92, "just four short words")]
    docs, want = [], set()
    for d in range(60):
        words = _words(rng, rng.randint(30, 200))
        if d % 3 == 0:
            i = rng.randrange(12)
            at = rng.choice([0, len(words), rng.randrange(len(words))])
            text = items[i][1].upper() if d % 2 else items[i][1].replace(" ", "\n", 2)
            words[at:at] = [text]
            want.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "Just four, short words!"), (102, "Just four, short words!")]
    part = " ".join(items[0][1].split()[:len(items[0][1].split()) // 2])
    docs.append((103, " ".join(_words(rng, 40)) + " " + part))   # half an item is no leak
    want.add((102, 92))
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, similarity double")
    got = decontam.find(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    clean = decontam.clean(table, bench)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    assert decontam.find(table, bench.limit(0)).count() == 0
    assert decontam.find(table.limit(0), bench).count() == 0
    assert decontam.clean(table, bench.limit(0)).count() == len(docs) and decontam.clean(table.limit(0), bench).count() == 0


def _leaks(docs, items, percent=80):
    """Plain Python over all windows: {(doc, item): (similarity, first word)} of the best windows at the threshold."""
    def grams(text):
        words = (text or "").lower().split()
        return [tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))] if words else []
    sets = {i: set(grams(t)) for i, t in items}
    n = sum(bool(v) for v in sets.values())
    held = collections.Counter(x for v in sets.values() for x in v)
    weight = lambda x: round(math.log1p(n / max(held[x], 1)) * decontam.STEP)
    total = lambda v: sum(map(weight, v))
    out = {}
    for d, t in docs:
        g = grams(t)
        for i, item in items:
            m = max(len((item or "").split()) - 4, 1)
            for at in range(1 - m, len(g)):
                window = set(g[max(at, 0):at + m])
                if (both := window & sets[i]) and 100 * total(both) >= percent * total(window | sets[i]):
                    out[d, i] = max(out.get((d, i), (0, 0)), (total(both) / total(window | sets[i]), -at))
    return {k: (v, -at) for k, (v, at) in out.items()}


def test_decontamination_against_all_windows(spark):
    """Items edited, cut, stretched and at the edges of documents, with stock phrases shared by items: recall of
    at least 0.99 among the pairs that reach the similarity, nothing else, and the exact similarity."""
    rng = random.Random(4)
    stock = " ".join(_words(rng, 12))
    items = [(i, " ".join([stock] * (i % 3 == 0) + _words(rng, rng.randint(15, 60)))) for i in range(60)]
    items += [(60, items[1][1] + " " + stock), (61, items[1][1])]   # nearly equal items
    docs = []
    for d in range(420):
        words = items[d % 62][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([["changed"], [], ["one", "more"]])
        if d % 7 == 0:
            words = words[rng.randint(0, 5):len(words) - rng.randint(0, 5)]
        docs.append((d, " ".join(_words(rng, rng.choice([0, 3, 40])) + words + _words(rng, rng.choice([0, 2, 30])))))
    docs.append((500, " ".join(w for _, t in items[:20] for w in t.split())))
    want = _leaks(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    for filter_bits in (24, 9):   # a filter that calls nearly everything known changes no result
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.find(table, bench, filter_bits=filter_bits).collect()}
        assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 150
        assert sum(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in got) >= 0.99 * len(got)
        assert any(v[0] < 0.9 for v in got.values())


def test_the_multi_index_is_complete(spark):
    """Every pair of fingerprints within the radius meets in a block, and pairs come from nowhere else."""
    rng = np.random.default_rng(5)
    prints = rng.integers(-2**63, 2**63, 60)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 30, 60)]
    probes = np.array([int(p) ^ (f - (1 << 64) if f >> 63 else f) for p, f in zip(prints, flips)])
    items = spark.createDataFrame([(i, 7, int(p)) for i, p in enumerate(prints)], "iid long, n_words int, print long")
    for radius in (0, 7, 19):
        index = {(r["block"], r["value"], r["iid"]) for r in decontam.multi_index(items, radius).collect()}
        for i, p in enumerate(probes):
            distance = bin((int(p) ^ int(prints[i])) & (2**64 - 1)).count("1")
            met = any((b, (int(p) >> 16 * b) & 0xFFFF, i) in index for b in range(4))
            assert met or distance > radius


def test_decontamination_finds_every_planted_passage(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()}
    bench = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pylist()}
    exact = {(d, i) for d, t in docs.items() for i, q in bench.items() if q in t}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontam(spark, SF_SMALL).collect()}
    assert exact <= got


def test_remove_repeats(spark, copies):
    period = "=-" * 700
    rows = [*copies, (20001, period + "abc"), (20002, "x" + period), (None, "Null id doc " * 20), (20005, "a" * 49),
            (20006, "a" * 49), (20007, "é" * 60), (20008, "b" + "é" * 60), (20009, "Null id doc " * 20)]
    want = brute.repeats(rows)
    got = suffix_dedup.remove_repeats(_table(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_interval_repeats_report_all_occurrences():
    text = b"xabcabcyabcz"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    suffixes = [text[i:] for i in order]
    lcp = [0] + [len(commonprefix([a, b])) for a, b in zip(suffixes, suffixes[1:])]
    left = [text[i - 1] if i else -1 for i in order]
    found = {(text[order[a]:order[a] + n], b - a + 1, low) for n, a, b, low in suffix_dedup.interval_repeats(left, lcp, order)}
    assert found == {(b"abc", 3, 1)}   # bc and c always follow a, so they are not maximal


def test_repeats_are_maximal_and_complete():
    """Against brute force: every left- and right-maximal string of 50 bytes or more over two documents or more."""
    rng = random.Random(3)
    common = [bytes(rng.choices(b"abc", k=rng.randint(60, 130))) for _ in range(4)]
    pieces, docs = [], []
    for d in range(14):
        pieces.append(bytes(rng.choices(b"xyz", k=rng.randint(1, 30))) + rng.choice(common)[rng.randint(0, 9):]
                      + bytes(rng.choices(b"uvw", k=rng.randint(0, 30))))
        docs.append(d // 2)
    pieces = [p + b"-" * max(0, 50 - len(p)) for p in pieces]
    got = suffix_dedup.Repeats(np.array(docs), np.zeros(len(docs), np.int64), pieces)
    repeat, suffix = got.occurrences()
    found = {}
    for r, x in zip(repeat.tolist(), suffix.tolist()):
        found.setdefault(r, set()).add((int(got.doc[x]), int(got.start[x])))
    want = {}
    where = {}
    for i, p in enumerate(pieces):
        for a in range(len(p)):
            for b in range(a + 50, len(p) + 1):
                where.setdefault(p[a:b], []).append((i, a))
    for text, occ in where.items():
        if len({docs[i] for i, _ in occ}) < 2:
            continue
        before = {pieces[i][a - 1] if a else (i, a) for i, a in occ}
        after = {pieces[i][a + len(text)] if a + len(text) < len(pieces[i]) else (i, a) for i, a in occ}
        starts_piece = any(a == 0 for _, a in occ)
        if (len(before) > 1 or starts_piece) and (len(after) > 1 or len(occ) > 1 and any(
                a + len(text) == len(pieces[i]) for i, a in occ)):
            want[text] = {(docs[i], a) for i, a in occ}
    several = [v for v in found.values() if len({d for d, _ in v}) > 1]
    assert {frozenset(v) for v in several} == {frozenset(v) for v in want.values()}


def test_stretches_without_repeats():
    found = suffix_dedup.Repeats(np.array([1, 2]), np.zeros(2, np.int64), [b"a" * 50, b"b" * 60])
    assert len(found.occurrences()[0]) == 0 and len(found.covered()[0]) == 0


def test_suffix_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()]
    want = brute.repeats(rows)
    for r in queries.op9_suffix_dedup(spark, SF_SMALL).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans) == want[r.doc_id][:3]
        assert r.kept_sha256 == brute.sha(want[r.doc_id][3])


def test_empty_suffix_dedup(spark):
    assert suffix_dedup.remove_repeats(_table(spark, [(1, "a")]).limit(0)).count() == 0


def test_dedup_stage_judges_rows_and_not_ids(spark):
    """An id with a copy and a text of its own keeps the latter; of equal rows one stays; null ids and wordless rows stay."""
    text = {k: f"{k} " + " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(3, text["a"]), (7, text["a"]), (7, text["b"]), (9, text["c"]), (9, text["c"]), (9, text["d"]), (11, text["b"] + " more"),
            (None, text["a"]), (None, text["c"]), (20, ""), (20, ""), (21, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r["text"]) for r in ngram_join.dedup_stage(spark, docs.repartition(3), "").collect()), key=str)
    assert got == sorted([(3, text["a"]), (7, text["b"]), (9, text["c"]), (9, text["d"]), (None, text["a"]), (None, text["c"]),
                          (20, ""), (20, ""), (21, None)], key=str)
