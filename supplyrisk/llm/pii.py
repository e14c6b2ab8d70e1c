"""Personal data: base patterns and information-theoretic sanitisation (native Spark expressions).

Base patterns find e-mail addresses, IP addresses, card and phone
numbers, the protected entities.  The method then asks how much the words of
a document reveal about its entities.  For an entity e and a term t (a
word of four letters or more, case folded), with counts over all documents
of the corpus,

    disclosure(t, e) = ln(p(e | t) * N / n_e) / ln(N / n_e)

is the share of e's information that t gives away: n_e documents hold e,
n_t hold t and n_et hold both.  p(e | t) is estimated with care: the lower
end of the confidence interval (Wilson's, ``z`` standard deviations) of
n_et / n_t, so a term seen once with e says less than one that is always
seen with it.  Where a document holds e, every occurrence
of a term whose disclosure passes ``generalise`` becomes a span, unless it
overlaps a base span; at ``remove`` or more it is removed from the text,
below that it is replaced by its general class.

As p(e | t) <= n_et / n_t <= n_e / n_t, only terms with n_t <= N^(1 - generalise) * n_e^generalise
can pass; others are left out before pairs are built, which changes no
result.  Entities held by the same documents share their disclosures and
are counted as one class.  Only classes, word places of documents with
entities, pairs and counts are shuffled, never texts; every count is
aggregated before its shuffle, so a hot entity or a hot term costs one row
per task.

Defined cases: null text is empty; rows with equal doc_id are separate
rows and one document for the counts; an entity that every document holds
has no information to disclose; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.columns import find_spans, let, replace_spans, span_text
from supplyrisk.plans import materialize

KINDS = ["email", "ip", "card", "phone", "term"]
#: ``(?<!X)|\G`` starts a match only where a run of X starts or the previous match ended: leftmost matches
#: are the same and a long run is scanned once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{4,}+"
#: The commonest of the words that cannot pass are dropped before the shuffle, at most so many; the join drops the rest.
COMMON = 100_000


@dataclass(frozen=True)
class Disclosure:
    generalise: float = 0.8
    remove: float = 0.95
    z: float = 1.96      # 0 takes the observed share itself


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def total(x: Column) -> Column:
        return F.aggregate(
            F.transform(F.filter(F.split(F.reverse(x), ""), lambda c: c != ""),
                        lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
                                         lambda v: F.when(v > 9, v - 9).otherwise(v))),
            F.lit(0), lambda a, v: a + v)
    return total(digits) % 10 == 0


def _parts_ok(m: Column) -> Column:
    def small(part: Column) -> Column:
        rest = F.ltrim(part, F.lit("0"))
        return (F.length(rest) < 3) | ((F.length(rest) == 3) & (rest <= "255"))
    return F.forall(F.split(m, r"\.", -1), small)


def base_spans(text: Column) -> list[Column]:
    def card_ok(x: Column) -> Column:
        return let(_digits(x["m"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    return [find_spans(text, EMAIL),
            F.filter(find_spans(text, IP), lambda x: _parts_ok(x["m"])),
            F.filter(find_spans(text, CARD), card_ok),
            F.filter(find_spans(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))]


def _value(k: int, m: Column) -> Column:
    """Key of an entity: 64-bit hash of its kind and normal form."""
    return F.xxhash64(F.lit(k), F.lower(m) if k == 0 else m if k == 1 else _digits(m))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def mentions(documents: DataFrame, keep: list[str], repeated: bool) -> DataFrame:
    """One row per input row: ``keep`` columns, ``row``, ``base`` (the entities) and ``words`` (terms with places).

    Rows without an entity get words only if ids are ``repeated``: then the
    entity can be in another row of the document.
    """
    out = documents.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kinds = base_spans(F.col("_t"))

    def tag(k: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"),
                                  _value(k, x["m"]).alias("v"))

    tagged = [F.transform(a, tag(k)) for k, a in enumerate(kinds)]
    out = out.select(*keep, F.col("_t"), F.monotonically_increasing_id().alias("row"), F.concat(*tagged).alias("base"))
    words = F.transform(find_spans(F.col("_t"), TERM),
                        lambda x: F.struct(_term(x["m"]).alias("t"), x["s"].alias("s"), x["e"].alias("e")))
    return out.select(*keep, "row", "base",
                      F.when(F.lit(repeated) | (F.size("base") > 0), words).alias("words"))


def _entity_classes(found: DataFrame) -> DataFrame:
    """(doc_id, c, n_e): the entities of every document; those held by the same documents are one class c."""
    held = found.select("doc_id", F.explode(F.array_distinct(F.transform("base", lambda x: x["v"]))).alias("v")).distinct()
    classes = held.groupBy("v").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("doc_id")).alias("a"),
                                    F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b"))
    return held.join(classes, "v").select("doc_id", F.xxhash64("n_e", "a", "b").alias("c"), "n_e").distinct()


def _frequency(documents: DataFrame, repeated: bool) -> DataFrame:
    """(t, n_t) of every word of the corpus; one row per word and task is shuffled, unless ids are ``repeated``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = documents.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), _term))).alias("t"))
    return (words.distinct() if repeated else words).groupBy("t").agg(F.count("*").alias("n_t"))


def disclosing_places(documents: DataFrame, found: DataFrame, rules: Disclosure, n_docs: int, repeated: bool) -> DataFrame:
    """(row, s, e, d): the places of disclosing terms, with the largest disclosure of the document's entities."""
    n = F.lit(float(n_docs))
    held = materialize(_entity_classes(found).filter(F.col("n_e") < n_docs), name="pii-entities")
    # slack for rounding: the disclosure itself decides below
    most = F.pow(n, F.lit(1 - rules.generalise)) * F.pow(F.col("n_e"), F.lit(rules.generalise)) * 1.000001
    bound = held.select(F.max(most)).first()[0] or 0.0
    frequency = materialize(_frequency(documents, repeated), name="pii-words")
    common = frequency.filter(F.col("n_t") > bound).orderBy(F.desc("n_t")).limit(COMMON).select("t")
    places = found.select("row", "doc_id", F.explode("words").alias("w")).select("row", "doc_id", "w.t", "w.s", "w.e") \
        .join(F.broadcast(common), "t", "left_anti") \
        .join(frequency.filter(F.col("n_t") <= bound), "t")
    held = held.withColumnRenamed("doc_id", "holder")
    terms = materialize(places.join(held, F.col("doc_id").eqNullSafe(F.col("holder"))).filter(F.col("n_t") <= most)
                        .select("row", "doc_id", "c", "n_e", "t", "n_t", "s", "e"), name="pii-terms")
    info = F.ln(n / F.col("n_e"))
    seen, share, z2 = F.col("n_t"), F.col("n_et") / F.col("n_t"), rules.z ** 2
    least = (share + z2 / (2 * seen) - rules.z * F.sqrt(share * (1 - share) / seen + z2 / (4 * seen * seen))) / (1 + z2 / seen)
    joint = F.ln(least * n / F.col("n_e"))
    pairs = terms.select("doc_id", "c", "n_e", "t", "n_t").distinct() \
        .groupBy("c", "n_e", "t", "n_t").agg(F.count("*").alias("n_et")) \
        .select("c", "t", (joint / info).alias("d")).filter(F.col("d") >= rules.generalise)
    return terms.select("row", "c", "t", "s", "e").join(pairs, ["c", "t"]) \
                .groupBy("row", "s", "e").agg(F.max("d").alias("d"))


def detect(documents: DataFrame, rules: Disclosure = Disclosure(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``spans``: array of (s, k, e); ``k`` indexes KINDS, and 5 marks a term to be removed."""
    keep = keep or ["doc_id"]
    ids = documents.groupBy("doc_id").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    repeated = (ids["most"] or 0) > 1
    found = materialize(mentions(documents, keep, repeated), name="pii")
    hits = disclosing_places(documents, found, rules, ids["n"], repeated).groupBy("row").agg(F.collect_list(F.struct(
        "s", F.when(F.col("d") >= rules.remove, F.lit(5)).otherwise(F.lit(4)).alias("k"), "e")).alias("terms"))
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    apart = F.filter(F.coalesce("terms", empty),
                     lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return found.join(hits, "row", "left").select(*keep, F.array_sort(F.concat(base, apart)).alias("spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """Entities and terms replaced by their class, terms to be removed by nothing."""
    names = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")])
    return replace_spans(text, spans, lambda k: F.element_at(names, k + 1))


def digest(found: DataFrame) -> DataFrame:
    """Per document: counts per base kind, the base spans' digest and all spans as text."""
    def n(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 4)
    return found.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"),
                        n(3).alias("n_phone"), F.sha2(span_text(base, KINDS), 256).alias("base_sha256"),
                        span_text(F.col("spans"), KINDS + ["term"]).alias("spans"))
