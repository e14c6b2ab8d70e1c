"""Quality rules, secret scan, personal data: against plain Python, with odd rows."""

import math
import random
import re

import pyarrow.parquet as pq
import pytest

from supplyrisk.llm import pii, quality, queries, secret_scan

from ..conftest import SF_SMALL
from . import brute

ODD = [None, "", " \t\n\x0b\f\r", "é" * 10, "a b c a b c a b c " * 30, "x\n\nx\n x\nx", "\x1c\x85 ſecret: abcdefgh",
       "token=token:abcdefg", "TOKEN = \"abcdef\" apikey:'abcde' api_key==abcdef", "AKIAAKIA" + "A" * 12, "AKIA" + "a" * 20,
       "z" + "0123456789abcdef" * 3 + "z", "a.b%c@d.e%f@g.h i@j", "....@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01",
       "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111", "+1 (377) 555-0271 +12 +1-2-3-4-5-6-7-8-9)",
       "1" * 5000, "a" * 5000 + "@", "+1" + " " * 3000, "a." * 3000 + "@" + "b." * 3000 + "c"]


def _texts():
    rng = random.Random(5)
    parts = ["token", "=", ":", '"', " ", "AKIA", "0af3", "9", "@", ".", "-", "+1", "(", "a\n", "é", "pass", "word", "|", "7 7"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(_texts())] + [(None, "null id", "en", 1), (0, None, "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, spans int").repartition(3)


def test_quality_matches_brute_force(odd):
    got = quality.judge(odd.drop("spans")).collect()
    assert len(got) == odd.count()
    for r in got:
        want = brute.quality(r["text"] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r["text"]
        assert not (r.base_failed and r.kept)


def test_quality_keeps_prose_and_rejects_navigation(spark):
    rng = random.Random(1)
    prose = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) + "." for _ in range(12))
    menu = " | ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(120))
    noisy = " ".join("".join(rng.choices("abcdefghij", k=4)) + "%%%" for _ in range(120))
    rows = spark.createDataFrame([(1, prose), (2, menu), (3, noisy), (4, prose + "\nAll rights reserved.")], "doc_id long, text string")
    kept = {r.doc_id: (r.kept, r.clean_text) for r in quality.judge(rows).collect()}
    assert [kept[i][0] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert kept[1][1] == prose and kept[4][1] == prose


def test_lines_are_judged_by_their_words(spark):
    """Words are what stands between any white space: tabs part them, runs of spaces do not add any."""
    prose = "A line of plain prose that ends like one, as it should.\n" * 12
    lines = {"These\tare\tfour\twords": True, "a   b": False, "a b": False, "a b c": True, "a  \x0b b.": True, "one | two | three words": False,
             "| ".join(["a long part of eight words it has"] * 3): True, "\t\t \t": True}
    rows = spark.createDataFrame([(i, prose + x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in quality.judge(rows).collect()}
    assert {x: got[i] == prose + x for i, x in enumerate(lines)} == lines


def test_secret_base_spans(odd):
    got = secret_scan.scan(odd).select("text", "spans").collect()
    assert len(got) == odd.count()
    for r in got:
        base = [(x.s, x.k, x.e) for x in r.spans if x.k < 3]
        have = ([sum(k == i for _, k, _ in base) for i in range(3)], brute.span_digest(base, secret_scan.KINDS))
        assert have == brute.secrets(r["text"] or ""), r["text"]


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=44)) for _ in range(30)]
    words = ["Abc1" * 11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1A", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ012345"] * 10
    rows = [(i, f"some words {k} here") for i, k in enumerate(keys + words)]
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = sum(got[i] == f"random:11:{11 + 44}" for i in range(30))
    assert found >= 28
    assert not any("random" in got[30 + i] for i in range(30))


def test_every_kind_of_random_token_is_found(spark):
    """Letters only, dashed one-case keys, a prefix before hex; rulers are not tested."""
    rng = random.Random(6)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    run = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    kinds = [lambda: run(letters + letters.upper(), 40), lambda: run(letters, 40), lambda: run(letters.upper(), 40),
             lambda: "-".join(run(digits + "abcdef", n) for n in (8, 4, 4, 4, 12)).upper(),
             lambda: "sk-" + run(digits + "abcdef", 40).upper(),
             lambda: "-".join(run(letters.upper() + digits, 5) for _ in range(6)),
             lambda: "_".join(run(letters + digits, 6) for _ in range(6)),
             lambda: run(letters + digits + "-_", 44), lambda: run(digits, 40)]
    keys = [kind() for kind in kinds for _ in range(12)]
    rulers = ["-" * 30, "=" * 40, "a" + "-" * 30 + "b", "a" + "=" * 30, "xyzxyzxyzxyzxyzxyzxyzxyz", "=-" * 20] * 20
    rows = spark.createDataFrame([(i, f"some words {k} here") for i, k in enumerate(keys + rulers)], "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.spans] for r in secret_scan.scan(rows).collect()}
    for k in range(len(kinds)):
        assert sum((11, 11 + len(keys[i])) in got[i] for i in range(12 * k, 12 * k + 12)) >= 10, keys[12 * k]
    assert not any(got[i] for i in range(len(keys), len(keys) + len(rulers)))


def _keys(rng):
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    run = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    return {
        "hex": lambda: run(digits + "abcdef", 32).upper(), "base64": lambda: run(letters + letters.upper() + digits + "+/", 44),
        "base62": lambda: run(letters + letters.upper() + digits, 32), "base32": lambda: run(letters.upper() + "234567", 32),
        "uuid": lambda: "-".join(run(digits + "abcdef", n) for n in (8, 4, 4, 4, 12)), "prefixed": lambda: "sk-" + run(letters + digits, 32),
        "letters": lambda: run(letters, 32), "licence": lambda: "-".join(run(letters.upper() + digits, 5) for _ in range(6)),
        "url-safe": lambda: run(letters + letters.upper() + digits + "-_", 43)}


def test_identifiers_of_real_code_are_left_alone_and_keys_among_them_found(spark):
    """The standard library's source, with keys planted in it: at most 1% of its long identifiers, paths and
    dashed words are reported, and at least 90% of the keys of every kind."""
    import sysconfig
    from pathlib import Path
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:150]
    texts = [f.read_text(errors="replace") for f in files]
    rng = random.Random(7)
    planted = [(kind, make()) for kind, make in _keys(rng).items() for _ in range(30)]
    rows = [*enumerate(texts), *((1000 + i, f"the value {key} is\nused by {rng.choice(texts)[:300]}") for i, (_, key) in enumerate(planted))]
    got = {r.doc_id: {(x.s, x.e) for x in r.spans if x.k == 3} for r in secret_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    runs = sum(len([m for m in re.finditer(secret_scan.TOKEN, t) if re.search("[A-Za-z0-9]", m[0])]) for t in texts)
    reported = sum(len(got[i]) for i in range(len(texts)))
    assert runs > 3000 and reported <= 0.01 * runs, (reported, runs)
    for kind in _keys(rng):
        hits = [(10, 10 + len(key)) in got[1000 + i] for i, (k, key) in enumerate(planted) if k == kind]
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits))


def test_text_model_counts_every_word(spark):
    rows = spark.createDataFrame([(1, "Ab ab"), (2, "ab1"), (3, None), (4, "aB " + "x" * 30)], "doc_id long, text string")
    model = secret_scan.text_model(rows)
    size, at = len(secret_scan.SYMBOLS), secret_scan.SYMBOLS.index
    pair = lambda a, b: model.log_p[at(a) * size + at(b)]
    # _ab_ twice, _ab0_ once, _a_b_ once
    assert pair("_", "a") == math.log((4 + 1) / (5 + size)) and pair("b", "_") == math.log((3 + 1) / (4 + size))
    assert pair("b", "0") == math.log((1 + 1) / (4 + size)) - math.log(10)
    assert secret_scan.text_model(rows.limit(0)) is None
    assert secret_scan.thresholds(rows.limit(0)) == {} and secret_scan.scan(rows.limit(0)).count() == 0


def test_redaction_replaces_spans(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefgh end", "en", "s", 20), (2, None, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r["text"], r.n_chars) for r in secret_scan.secret_stage(spark, docs, "").collect()}
    assert got == {1: ("é [SECRET] end", 14), 2: ("", 0)}


def test_pii_base_spans(odd):
    rows = odd.select("doc_id", "text").filter("doc_id is not null")
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(r["text"] or "")
    got = pii.digest(pii.detect(rows)).collect()
    assert len(got) == rows.count()
    for r in got:
        have = ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256)
        assert have in [brute.pii(t) for t in texts[r.doc_id]], texts[r.doc_id]


def test_disclosing_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows = [(i, " ".join(word() for _ in range(30)) + " common end.") for i in range(200)]
    rows += [(1000 + i, f"the common words and zanzibar wrote joe@mail.org. {word()}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.detect(docs, keep=["doc_id", "text"])
    clean = {r.doc_id: r.t for r in out.select("doc_id", pii.sanitise(out["text"], out["spans"]).alias("t")).collect()}
    assert "zanzibar" not in clean[1000] and "[EMAIL]" in clean[1000] and "common" in clean[1000]
    assert clean[5] == dict(rows)[5]


@pytest.mark.parametrize("z", [0.0, 1.96])
def test_disclosing_terms_match_brute_force(spark, z):
    """Single-document entities, terms on other lines and far away, entities in many documents, repeated ids."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcd", k=4))
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 60))) + ("\n" if i % 2 else " ")
             + ("(Tall) mail hub@mail.org " if i < 30 else "") + ("x" * 200 + " Quokka" if i < 32 else "")) for i in range(60)]
    rows += [(70, "Wombat one@pub.org\n" + "filler " * 30 + "wombat, (WOMBAT)"), (71, None), (72, "two@pub.org three@pub.org")]
    repeats = [(72, "Numbat"), (72, "Numbat"), (None, "four@pub.org Bilby")]
    for table in (rows, rows + repeats):
        texts, held, has = {}, {}, {}
        for d, t in table:
            texts.setdefault(d, []).append(t or "")
        mail = r"[a-z]+@[a-z]+\.org"
        for d, ts in texts.items():
            for t in ts:
                for v in re.findall(mail, t):
                    held.setdefault(v, set()).add(d)
                for w in re.findall("[A-Za-z]{4,}", t):
                    has.setdefault(w.lower(), set()).add(d)
        n, want = len(texts), []
        for d, t in table:
            spans = [(m.start(), 0, m.end()) for m in re.finditer(mail, t or "")]
            terms = []
            for m in re.finditer("[A-Za-z]{4,}", t or ""):
                docs = has[m[0].lower()]
                def least(e):
                    seen, share = len(docs), len(docs & e) / len(docs)
                    return (share + z * z / 2 / seen - z * math.sqrt(share * (1 - share) / seen + z * z / 4 / seen / seen)) / (1 + z * z / seen)
                best = max((math.log(least(e) * n / len(e)) / math.log(n / len(e)) for e in held.values() if d in e), default=0)
                if best >= 0.8 and not any(a < m.end() and m.start() < b for a, _, b in spans):
                    terms.append((m.start(), 5 if best >= 0.95 else 4, m.end()))
            want.append((d, sorted(spans + terms)))
        docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
        got = [(r.doc_id, [tuple(x) for x in r.spans]) for r in pii.detect(docs, pii.Disclosure(z=z)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op3_pii", "op5_secrets", "op6_quality"])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") \
         .write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_queries_match_brute_force_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()}
    for r in queries.op3_pii(spark, SF_SMALL).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute.pii(docs[r.doc_id])
    for r in queries.op5_secrets(spark, SF_SMALL).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == brute.secrets(docs[r.doc_id])
    for r in queries.op6_quality(spark, SF_SMALL).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == \
            brute.quality(docs[r.doc_id])
