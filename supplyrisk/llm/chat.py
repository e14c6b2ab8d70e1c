"""Chat formatting: conversations as one training string with a loss mask.

Relational formatting with Spark expressions only: the turns of a
conversation are collected as structs and sorted, adjacent turns of one
role share one block, and the blocks are concatenated.

Template (control strings start with ``<``, which escaped text never
contains)::

    <|start|>role\\ntext<|next|>text<|end|>\\n

Inside texts ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l``, which
``unescape`` undoes.  ``<|next|>`` separates the turns of a block, so
``read_back`` returns exactly the rows that went in.  The loss mask
covers the escaped text of every assistant turn.

Defined cases: null text and null role are empty strings; turns sort by
(turn, role, text), nulls first; repeated rows are kept; rows with a null
conv_id form one conversation; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.llm.columns import chunked, let, prefix_sums

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>\n"
NEXT_RE, END_RE = r"<\|next\|>", r"<\|end\|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): ``loss_mask`` is an array of (start, end) code points."""
    rows = conversations.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("roles", F.transform("turns", lambda t: t["role"]))
    null = F.array(F.lit(None).cast("string"))
    size = F.size("roles")
    convs = convs.select(
        "conv_id",
        F.arrays_zip(F.col("turns").alias("t"), F.concat(null, F.slice("roles", 1, size - 1)).alias("before"),
                     F.concat(F.slice("roles", 2, size), null).alias("after")).alias("z"))
    # per turn: what opens it, its escaped text, what closes it
    parts = convs.select("conv_id", F.transform("z", lambda z: F.struct(
        F.when(z["before"].eqNullSafe(z["t"]["role"]), F.lit(NEXT))
         .otherwise(F.concat(F.lit(START), _escape_role(z["t"]["role"]), F.lit("\n"))).alias("open"),
        escape(z["t"]["text"]).alias("text"),
        F.when(z["after"].eqNullSafe(z["t"]["role"]), F.lit("")).otherwise(F.lit(END)).alias("close"),
        (z["t"]["role"] == loss_role).alias("loss"))).alias("parts"))
    ends = prefix_sums(F.transform("parts", lambda p: F.length(p["open"]) + F.length(p["text"]) + F.length(p["close"])))
    mask = F.transform(
        F.filter(F.zip_with(ends, "parts", lambda e, p: F.struct(e.alias("e"), p.alias("p"))),
                 lambda x: x["p"]["loss"]),
        lambda x: let(x["e"] - F.length(x["p"]["close"]), lambda end: F.struct(
            (end - F.length(x["p"]["text"])).alias("start"), end.alias("end"))))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["text"], p["close"])), "")
    return parts.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) turns, as they went in."""
    blocks = F.filter(F.split(formatted, END_RE, -1), lambda b: F.length(b) > 0)

    def turns(block: Column) -> Column:
        # a block is the start mark, the role up to the first newline, then the texts
        cut = F.split(F.substring(block, len(START) + 1, 2147483647), "\n", 2)
        return let(cut, lambda c: F.transform(F.split(c[1], NEXT_RE, -1), lambda s: F.struct(
            _unescape_role(c[0]).alias("role"), unescape(s).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_mask: Column, chunk: int = 64) -> Column:
    """Unescaped text under the mask; the string is cut per chunk of spans, so long ones stay cheap."""
    def part(spans: Column) -> Column:
        first = spans[0]["start"]
        cut = formatted.substr(first + 1, F.element_at(spans, -1)["end"] - first)
        return let(cut, lambda c: F.array_join(F.transform(
            spans, lambda s: c.substr(s["start"] - first + 1, s["end"] - s["start"])), ""))
    return F.when(F.size(loss_mask) > 0, unescape(let(loss_mask, lambda m: F.array_join(
        F.transform(chunked(m, chunk), part), "")))).otherwise(F.lit(""))
