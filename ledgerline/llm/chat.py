"""Chat formatting in budgeted windows, with reversible escapes and a loss mask.

Turns lie on a line of token counts per conversation.  A window's budget holds the
system turn, the history and the new turns, so new turns may use what the system
turn and ``history_tokens`` leave of it.  Prefix sums cut the line at turn ends into
spans of about half of that; a longer turn is a span of its own.  A window is a span
with, before it, the system turn and a limited number of turns repeated from the
span before, as far as they fit.  Turns are never cut and the system turn is always
there: a window of one new turn that doesn't fit beside the system turn is
marked ``over_budget``.  The loss mask covers the assistant's new turns only, so
each is a target exactly once.

Everything is DataFrame functions: windows over the conversation, one explode of
turns to their windows, one grouping by window.  A conversation's turns are ordered
and digested as one, so a conversation has to fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Control strings of the template.
TURN, END = "### ", "</turn>"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class ChatParams:
    #: Tokens (words, and ``overhead`` a turn) of a window, context included.
    budget: int = 1024
    overhead: int = 4
    #: Turns repeated from the span before, at most, and their tokens.
    history_turns: int = 2
    history_tokens: int = 256
    target_role: str = "assistant"


def escape(text: Column) -> Column:
    r"""Control strings as codes of a backslash and a letter; a backslash is ``\b``, so every backslash begins a code."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("###"), F.lit("\\h")), F.lit(END), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.replace(F.replace(F.replace(text, F.lit("\\t"), F.lit(END)), F.lit("\\h"), F.lit("###")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_windows(turns: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, window (from 1), text, mask (start, end in code points), n_context, n_new, n_tokens and over_budget of each window of ``turns``.

    Turns are ordered by turn (null first), role and text; rows that repeat are
    turns of their own.  A null text or role is empty.  A null conv_id is a
    conversation.  Texts of any length are kept whole.  Other columns take no part.
    """
    conv = Window.partitionBy("conv_id")
    line = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    tokens = F.regexp_count("body", F.lit(WORD)) + p.overhead
    placed = base.withColumn("tokens", tokens).withColumn("pos", F.row_number().over(line))
    by_pos = conv.orderBy("pos")
    up_to = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    system = F.min(F.when(F.col("role") == "system", F.struct("pos", "tokens"))).over(conv)
    placed = placed.withColumn("sys", system).withColumns({"system": F.col("sys.pos"), "kept": F.coalesce("sys.tokens", F.lit(0))})
    # half of what new turns may use: spans of whole turns of up to half stay within it
    half = F.greatest(F.floor((p.budget - p.history_tokens - F.col("kept")) / 2), F.lit(1))
    placed = (
        placed.withColumn("half", half)
        .withColumn("cell", F.floor((F.sum("tokens").over(up_to) - F.col("tokens")) / F.col("half")))
        .withColumn("long", F.col("tokens") > F.col("half"))
        .withColumn("cut", F.coalesce(F.col("long") | F.lag("long").over(by_pos) | (F.lag("cell").over(by_pos) != F.col("cell")), F.lit(True)).cast("int"))
        .withColumn("span", F.sum("cut").over(up_to))
        .withColumn("spans", F.max("span").over(conv))
        .withColumn("next", F.sum("tokens").over(conv.orderBy("span").rangeBetween(1, 1)))
    )
    back = Window.partitionBy("conv_id", "span").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_system = F.coalesce(F.col("pos") == F.col("system"), F.lit(False))
    spare = F.least(F.lit(p.history_tokens), p.budget - F.col("kept") - F.col("next"))
    repeats = (F.col("span") < F.col("spans")) & ~is_system & (F.sum("tokens").over(back) <= spare) & (F.count(F.lit(1)).over(back) <= p.history_turns)
    placed = placed.withColumn("repeats", repeats)
    place = lambda span, kind: F.struct(span.cast("long").alias("window"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<window:bigint,kind:int>>")
    places = F.concat(
        F.array(place(F.col("span"), 2)),
        F.when(F.col("repeats"), F.array(place(F.col("span") + 1, 1))).otherwise(none),
        F.when(is_system & (F.col("span") < F.col("spans")), F.transform(F.sequence(F.col("span") + 1, F.col("spans")), lambda s: place(s, 0))).otherwise(none),
    )
    shown = placed.select("conv_id", "pos", "role", "body", "tokens", F.explode(places).alias("at")).select("conv_id", "pos", "tokens", "at.*", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit(": ")).alias("head"), escape(F.col("body")).alias("body"), (F.col("role") == p.target_role).alias("wanted"))
    shown = shown.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    inside = Window.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("piece").cast("long")).over(inside) - F.length("body") - len(END) - 1
    shown = shown.withColumn("start", start)
    target = (F.col("kind") == 2) & F.col("wanted")
    return (
        shown.groupBy("conv_id", "window")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "pos", "piece"))), lambda x: x["piece"]), "").alias("text"),
            F.sort_array(F.collect_list(F.when(target, F.struct("start", (F.col("start") + F.length("body")).alias("end"))))).alias("mask"),
            F.count_if(F.col("kind") < 2).alias("n_context"),
            F.count_if(F.col("kind") == 2).alias("n_new"),
            F.sum("tokens").alias("n_tokens"),
        )
        .withColumn("over_budget", F.col("n_tokens") > p.budget)
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """``windows`` with turns (role, text), the new ones, and targets, the texts under the mask, read from the formatted text."""
    parts = F.filter(F.split("text", F.lit(END + "\n"), -1), lambda x: x != "")
    parsed = F.transform(
        F.slice(parts, F.col("n_context").cast("int") + 1, F.col("n_new").cast("int")),
        lambda x: F.struct(
            unescape_role(F.substring(x, F.lit(len(TURN) + 1), F.instr(x, F.lit(": ")) - len(TURN) - 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, F.lit(": ")) + 2, F.length(x))).alias("text"),
        ),
    )
    masked = F.transform("mask", lambda m: unescape(F.substring(F.col("text"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return windows.withColumn("turns", parsed).withColumn("targets", masked)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted windows: counts and digests of its turns and of the text under the mask."""
    read = read_turns(windows).select(
        "conv_id",
        "window",
        "n_new",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("block"),
        F.array_join("targets", "").alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    joined = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", name))), lambda x: x[name]), "")
    return read.groupBy("conv_id").agg(
        F.sum("n_new").alias("n_turns"),
        F.sha2(joined("block"), 256).alias("turns_sha256"),
        F.sum(F.length("loss").cast("long")).alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )
