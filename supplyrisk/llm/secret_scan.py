"""Secret scan with a randomness test battery (native Spark expressions).

Base patterns find assignments, access keys and long hex strings.  The
method then looks at every run of 20 or more key characters and reports
those that are both unlike the corpus's text and random.

**Unlike text.** The null hypothesis, the one that must be rejected, is that
a run is made like the corpus's words.  Letter pairs of all words of all
documents, but those with a run to be tested, are counted (letters case folded, digits as one class that shares
its probability evenly, all else as separators, and a change from lower to
upper case as a separator too, so compound names read as their words).  A run's mean log-likelihood under these pairs is compared
with the corpus mean; its spread is taken from whole words, as the letters of
a word depend on each other, times ``Battery.spread``.  The lower tail gives the p-value.

**Random.** A run is tested in up to three readings: the whole run, with its
separators (``+/-_=``) as two more digits of the alphabet; the run without
its separators; and every piece of 20 characters or more between separators.
A reading's encoding follows from the kinds of characters it holds (digits,
hex, one or two cases of letters, base32, base36, base62, base64), as a random
text of a larger alphabet that happens to hold no digit, say, is uniform over
the letters.  The characters become digits of that alphabet, and the
hypothesis "uniformly random" is tested three ways: chi-squared uniformity of
the alphabet, runs above and below the middle digit, and lag-1 serial
correlation.  The smallest of the three p-values, times three, is the
reading's p-value; the run's is the largest of its readings, as a run random
in any reading is random.  A run below ``Battery.random_at`` there counts as
not random, and its p-value of being text as 1.  Runs without a letter or
digit are not tested and not counted.

A Benjamini-Hochberg step-up per length band, over all tested runs of the
corpus, picks what is reported, so among the reported runs of a band the
expected share of text-like ones is at most the band's rate.  Reported runs
become spans of kind ``random`` unless a base span contains them.

The step-up needs only a histogram of p-values per band (bands x bins rows),
the model is one number per letter pair; both are literals of the later
passes, so texts are never shuffled.  Words are counted before the shuffle.

Runs of digits alone read as numbers, which text holds too, and are reported
only where the corpus has hardly any.  Defined cases: null text is empty; repeated rows are scanned alike; an
empty table, or one without words, has no thresholds and no random spans;
other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.columns import WS_CLASS, find_spans, let, replace_spans, span_text
from supplyrisk.plans import materialize

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"     # the whole run of A-Z0-9, 20 or more in all
HEX = r"[0-9a-f]{24,}+"           # a run of 24 or more starts where its maximal run starts
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of the encodings, in digit order (fixed by their standards); one-case ones in lower case.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": "0123456789abcdef",
    "letters": _LOWER,
    "base32": _LOWER + "234567",
    "base36": _DIGITS + _LOWER,
    "base52": _LOWER.upper() + _LOWER,
    "base62": _LOWER.upper() + _LOWER + _DIGITS,
}
SEPARATORS = "+/"     # digits 62 and 63 of base64; the url-safe ones and inner padding are mapped to them
PIECE = 20            # shortest stripped run or piece that is a reading by itself


@dataclass(frozen=True)
class Battery:
    bands: tuple = ((20, 0.01), (32, 0.005), (64, 0.001))   # (shortest length, false-discovery rate of what is reported)
    spread: float = 2.0        # a run's spread against that of words: names, codes and paths vary more
    random_at: float = 0.001   # p-value of the randomness tests below which a run is not random
    bins_per_e: int = 8        # histogram bins per factor e of the p-value
    max_bin: int = 400


#: Symbols of the text model: letters, any digit, anything else.
SYMBOLS = _LOWER + "0_"


@dataclass(frozen=True)
class TextModel:
    """Log-probability of every symbol after every symbol, and the corpus's mean and spread per symbol."""
    log_p: tuple      # row by row in the order of SYMBOLS
    mean: float
    sd: float


def _symbols(word: Column) -> Column:
    """A word in SYMBOLS, between separators; a change from lower to upper case separates too."""
    parted = F.regexp_replace(word, "([a-z])([A-Z])", "$1_$2")
    plain = F.regexp_replace(F.translate(F.lower(parted), "123456789", "000000000"), "[^a-z0]+", "_")
    return F.concat(F.lit("_"), F.btrim(plain, F.lit("_")), F.lit("_"))


def _pairs(symbols: Column) -> Column:
    """Consecutive symbol pairs as their places in ``TextModel.log_p``."""
    n = len(SYMBOLS)
    at = F.transform(F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    return let(at, lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * n + b))


def _log_p(pairs: Column, log_p: tuple) -> Column:
    """Log-likelihood of symbol pairs."""
    table = F.split(F.lit(",".join(map(repr, log_p))), ",").cast("array<double>")
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.get(table, i))


def text_model(documents: DataFrame) -> TextModel | None:
    """The model of all words of all documents; None without words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = documents.select(F.explode(F.split(text, f"[{WS_CLASS}]+", -1)).alias("w")) \
        .filter((F.col("w") != "") & ~F.col("w").rlike(TOKEN))   # what is to be tested is no model of text
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # words alike in SYMBOLS count as one
    words = materialize(words.groupBy(_symbols(F.col("w")).alias("w")).agg(F.sum("n").alias("n")), name="words")
    size = len(SYMBOLS)
    rows = words.select("n", F.explode(_pairs(F.col("w"))).alias("i")).groupBy("i").agg(F.sum("n").alias("n")).collect()   # size^2 rows
    if not rows:
        return None
    counts = [0] * size * size
    for r in rows:
        counts[r["i"]] = r["n"]
    after = [sum(counts[a * size:(a + 1) * size]) for a in range(size)]
    # a digit stands for ten characters
    log_p = tuple(math.log((counts[a * size + b] + 1) / (after[a] + size)) - (math.log(10) if SYMBOLS[b] == "0" else 0.0)
                  for a in range(size) for b in range(size))
    total = sum(counts)
    mean = sum(c * p for c, p in zip(counts, log_p)) / total
    off = _log_p(_pairs(F.col("w")), log_p) - mean * (F.length("w") - 1)
    spread = words.agg((F.sum(F.col("n") * off * off) / F.sum(F.col("n") * (F.length("w") - 1))).alias("v")).first()["v"]
    return TextModel(log_p, mean, math.sqrt(max(spread, 1e-6)))


def _text_p(token: Column, model: TextModel, spread: float) -> Column:
    """Probability that a run made like the corpus's words is as unlikely as this one."""
    def tail(pairs: Column) -> Column:
        n = F.size(pairs).cast("double")
        z = (_log_p(pairs, model.log_p) - model.mean * n) / (spread * model.sd * F.sqrt(n))
        return F.when(z < 0, _tail(z) / 2).otherwise(F.lit(1.0))
    return let(_pairs(_symbols(token)), tail)


def base_spans(text: Column) -> list[Column]:
    assign = F.filter(find_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    return [assign, find_spans(text, ACCESS), find_spans(text, HEX)]


def _tail(z: Column) -> Column:
    """P(|Z| > |z|) of the standard normal (rational approximation of erfc)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _encoding(body: Column) -> Column:
    """(alphabet, digits text) of letters, digits and ``+/``; null without a letter or digit."""
    low = F.lower(body)

    def pick(name: str, digits: Column) -> Column:
        return F.struct(F.concat(F.lit(ALPHABETS[name]), F.when(body.rlike("[+/]"), SEPARATORS).otherwise("")).alias("a"),
                        digits.alias("d"))

    both = body.rlike("[a-z]") & body.rlike("[A-Z]")
    digit = body.rlike("[0-9]")
    return F.when(~body.rlike("[A-Za-z0-9]"), None) \
        .when(both & digit, pick("base62", body)) \
        .when(both, pick("base52", body)) \
        .when(low.rlike("^[0-9+/]+$"), pick("decimal", low)) \
        .when(~digit, pick("letters", low)) \
        .when(low.rlike("^[0-9a-f+/]+$"), pick("hex", low)) \
        .when(low.rlike("^[a-z2-7+/]+$"), pick("base32", low)) \
        .otherwise(pick("base36", low))


def _readings(token: Column) -> Column:
    """The texts of a token to be tested: whole, without separators, its long pieces."""
    body = F.regexp_replace(token, "(?<!=)={1,2}$", "")
    parts = F.when(body.rlike("[+/_=-]"), F.filter(
        F.concat(F.array(F.regexp_replace(body, "[+/_=-]", "")), F.split(body, "[+/_=-]+")),
        lambda x: F.length(x) >= PIECE)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.translate(body, "-_=", "+//")), parts)


def _p_value(enc: Column) -> Column:
    """Smallest of the three tests' p-values, times three (at most 1); null without an encoding."""
    def tests(x: Column) -> Column:
        n = F.length(x["d"]).cast("double")
        size = F.length(x["a"]).cast("double")
        # chi-squared against equal frequencies, upper tail by the cube-root normal form
        square = F.aggregate(F.transform(F.split(x["a"], ""), lambda c: n - F.length(F.replace(x["d"], c, F.lit("")))),
                             F.lit(0.0), lambda s, c: s + c * c)
        dof = size - 1
        chi = square * size / n - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / dof, F.lit(1 / 3)) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
        p_chi = F.when(z_chi > 0, _tail(z_chi) / 2).otherwise(F.lit(1.0))

        def ordered(v: Column) -> Column:
            nxt = F.slice(v, 2, F.size(v))
            pairs = F.filter(F.zip_with(v, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                             lambda q: q["b"].isNotNull())
            mean = F.aggregate(v, F.lit(0.0), lambda s, q: s + q) / n
            var = F.aggregate(v, F.lit(0.0), lambda s, q: s + (q - mean) * (q - mean))
            cov = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + (q["a"] - mean) * (q["b"] - mean))
            mid = (size - 1) / 2
            above = F.size(F.filter(v, lambda q: q > mid)).cast("double")
            below = n - above
            runs = 1 + F.size(F.filter(pairs, lambda q: (q["a"] > mid) != (q["b"] > mid)))
            mu = 2 * above * below / n + 1
            sd = (mu - 1) * (mu - 2) / (n - 1)
            p_runs = F.when(sd > 0, _tail((runs - mu) / F.sqrt(sd))).otherwise(F.lit(1e-300))
            p_serial = F.when(var > 0, _tail((cov / var + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-300))
            return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

        digits = F.transform(F.filter(F.split(x["d"], ""), lambda c: c != ""),
                             lambda c: (F.instr(x["a"], c) - 1).cast("double"))
        return let(digits, ordered)

    return F.when(enc.isNotNull(), let(enc, tests))


def _band(length: Column, battery: Battery) -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(battery.bands):
        out = F.when(length >= least, F.lit(i)).otherwise(out)
    return out


def _tokens(text: Column, battery: Battery, model: TextModel) -> Column:
    """Array of (s, k, e, band, bin): tested runs with their p-value's bin (higher: less like text)."""
    def tested(x: Column) -> Column:
        # the randomness tests run only on what is unlike text
        random = F.array_max(F.transform(_readings(x["m"]), lambda r: _p_value(_encoding(r))))
        p = let(_text_p(x["m"], model, battery.spread), lambda t: F.when(t > 0.5, F.lit(1.0)).when(random >= battery.random_at, t).otherwise(F.lit(1.0)))
        bin_ = F.least(F.floor(-F.ln(p) * battery.bins_per_e), F.lit(battery.max_bin)).cast("int")
        return F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"),
                        _band(x["e"] - x["s"], battery).alias("band"), bin_.alias("bin"))
    return F.transform(F.filter(find_spans(text, TOKEN), lambda x: x["m"].rlike("[A-Za-z0-9]")), tested)


def thresholds(documents: DataFrame, battery: Battery = Battery(), model: TextModel | None = None) -> dict[int, int]:
    """Per band, the lowest bin that is reported (step-up over the corpus); a band that reports none has no entry."""
    model = model or text_model(documents)
    if model is None:
        return {}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hist = documents.select(text.alias("_t")).filter(F.col("_t").rlike(TOKEN)) \
        .select(F.explode(_tokens(F.col("_t"), battery, model)).alias("t")) \
        .groupBy("t.band", "t.bin").agg(F.count("*").alias("n")).collect()   # bands x bins rows
    cuts = {}
    for band, (_, rate) in enumerate(battery.bands):
        bins = {r["bin"]: r["n"] for r in hist if r["band"] == band}
        upto = 0
        for b in sorted(bins, reverse=True):   # ascending p-values; every one in the bin is at most exp(-b / bins_per_e)
            upto += bins[b]
            if b > 0 and math.exp(-b / battery.bins_per_e) <= rate * upto / sum(bins.values()):
                cuts[band] = b
    return cuts


def scan(documents: DataFrame, battery: Battery = Battery(), cuts: dict[int, int] | None = None,
         model: TextModel | None = None) -> DataFrame:
    """Input columns plus ``spans``, an array of (s, k, e); ``k`` indexes KINDS.

    ``model`` and ``cuts`` come from the documents themselves unless given (``text_model``, ``thresholds``).
    """
    model = model or text_model(documents)
    cuts = thresholds(documents, battery, model) if cuts is None else cuts
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = documents.withColumn("_t", text)
    out = out.withColumn("_base", F.array(*base_spans(F.col("_t"))))
    out = out.withColumn("_base", F.flatten(F.transform("_base", lambda spans, k: F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e"))))))
    spans = F.col("_base")
    if model is not None and cuts:
        limits = F.array(*[F.lit(cuts.get(i, battery.max_bin + 1)) for i in range(len(battery.bands))])
        out = out.withColumn("_tok", F.filter(_tokens(F.col("_t"), battery, model),
                                              lambda t: t["bin"] >= F.element_at(limits, t["band"] + 1)))
        extra = F.transform(
            F.filter("_tok", lambda t: ~F.exists("_base", lambda b: (b["s"] <= t["s"]) & (b["e"] >= t["e"]))),
            lambda t: F.struct(t["s"].alias("s"), t["k"].alias("k"), t["e"].alias("e")))
        spans = F.concat("_base", extra)
    return out.withColumn("spans", F.array_sort(spans)).drop("_t", "_base", "_tok")


def redact(text: Column, spans: Column) -> Column:
    return replace_spans(text, spans, lambda k: F.lit("[SECRET]"))


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every secret span is replaced in the text."""
    clean = scan(docs).withColumn("text", redact(F.coalesce("text", F.lit("")), F.col("spans")))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: counts per base kind, the base spans' digest and all spans as text."""
    def n(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 3)
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                          F.sha2(span_text(base, KINDS), 256).alias("base_sha256"),
                          span_text(F.col("spans"), KINDS).alias("spans"))
