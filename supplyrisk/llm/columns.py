"""Column helpers shared by the native text operators (no Python in tasks).

Offsets are code points, ends exclusive.  Regexes are Java regexes; the
callers write them without nested greedy groups, so matching neither
recurses nor goes quadratic on long runs of one character class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as a regex class body and as the literal characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def chunked(arr: Column, size: int) -> Column:
    """Array of consecutive slices of ``arr`` (an attribute or lambda variable), empty for an empty array."""
    n = F.size(arr)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")),
                                     lambda c: F.slice(arr, c * size + 1, F.lit(size)))) \
            .otherwise(F.array(arr))


def prefix_sums(values: Column, size: int = 512) -> Column:
    """Inclusive running sums of an int array, in slices so that long arrays stay near linear."""
    ints = F.array().cast("array<int>")

    def step(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["t"].alias("t"), ints.alias("o")),
                            lambda a, x: F.struct((a["t"] + x).alias("t"),
                                                  F.concat(a["o"], F.array(a["t"] + x)).alias("o")))
        return let(inner, lambda r: F.struct(r["t"].alias("t"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    zero = F.struct(F.lit(0).alias("t"), F.array().cast("array<array<int>>").alias("o"))
    return let(values, lambda v: F.flatten(F.aggregate(chunked(v, size), zero, step, lambda a: a["o"])))


SPAN = "array<struct<s:int,e:int,m:string,pre:string,post:string>>"


def find_spans(text: Column, regex: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (s, e, m, pre, post).

    ``pre``/``post`` are up to ``context`` code points between this match
    and its neighbours.  The text between matches comes from ``split``
    and the matches from ``regexp_extract_all``; their lengths add up to
    the offsets.  Texts without a match cost one regex scan.
    """
    def build(_: Column) -> Column:
        pieces = F.split(text, regex, -1)
        matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        return let(F.struct(pieces.alias("p"), matches.alias("m")), lambda x: let(
            F.arrays_zip(
                prefix_sums(F.zip_with(F.slice(x["p"], 1, F.size(x["m"])), x["m"],
                                       lambda p, m: F.length(p) + F.length(m))).alias("e"),
                x["m"].alias("m"),
                F.slice(x["p"], 1, F.size(x["m"])).alias("a"),
                F.slice(x["p"], 2, F.size(x["m"])).alias("b")),
            lambda z: F.transform(z, lambda r: F.struct(
                (r["e"] - F.length(r["m"])).alias("s"), r["e"].alias("e"), r["m"].alias("m"),
                F.right(r["a"], F.lit(context)).alias("pre"), F.left(r["b"], F.lit(context)).alias("post")))))

    return F.when(text.rlike(regex), build(text)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def span_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of an array of structs (s, k, e), by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, k: int) -> Column:
    """Spans of ``find_spans`` as (s, k, e)."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def merged_runs(spans: Column) -> Column:
    """Overlapping or touching (s, k, e) spans merged into disjoint (s, k, e); k is the first one's."""
    kind = "array<struct<s:int,k:int,e:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["s"].alias("s"), last["k"].alias("k"),
                                           F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"]), joined) \
                .otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def replace_spans(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each merged (s, k, e) span replaced by ``label(k)``."""
    def build(runs: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["e"]))
        ends = F.concat(F.transform(runs, lambda r: r["s"]), F.array(F.length(text)))
        keep = F.zip_with(starts, ends, lambda a, b: text.substr(a + 1, b - a))
        marks = F.concat(F.transform(runs, lambda r: label(r["k"])), F.array(F.lit("")))
        return F.array_join(F.zip_with(keep, marks, lambda k, m: F.concat(k, m)), "")
    return F.when(F.size(spans) > 0, let(merged_runs(spans), build)).otherwise(text)
