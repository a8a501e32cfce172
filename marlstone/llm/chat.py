"""Chat formatting by prefix-target expansion (DataFrame functions only).

A conversation is laid out as a buffer of turns,
``<|im_start|>role\\ntext<|im_end|>\\n`` each.  Every assistant turn is an
example of its own: the buffer up to that turn's end, of which only the reply's
text is trainable.  ``expand`` makes these examples, one row each with its whole
text and loss mask: a conversation of n replies has n texts of growing length,
which are made and passed on one at a time.

Control strings in texts and roles are escaped reversibly: ``<`` + k backslashes
+ ``|`` gets one more backslash, so the buffer has ``<|`` at its own marks alone;
a line break in a role becomes ``<n|``.

Defined results: null texts and roles are empty; turns go by ``turn``, null
first, ties by role, then text; repeated rows are turns of their own; a
conversation without assistant turns has a buffer and no examples; very long
texts and conversations are bounded by what one row may hold (2 GB), as an
example is one row; other columns of the input, whatever their names, are left
out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(n?)(\\*)\|", r"<$1\\$2|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(n?)\\(\\*)\|", r"<$1$2|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "<n|")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"<n\|", "\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (the buffer) and examples: array of (target turn, loss_start, loss_end, example_end).

    One shuffle by conversation; offsets are code points from 0, ends exclusive.
    """
    blank = F.lit("")
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", blank)), F.lit("\n"))
    body = escape(F.coalesce("text", blank))
    rows = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("at"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("raw"),
        head.alias("head"),
        body.alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("at", "role", "raw")
    size = F.length("head") + F.length("body") + len(END)
    placed = rows.select(
        "conv_id",
        F.row_number().over(order).alias("no"),
        F.concat("head", "body", F.lit(END)).alias("segment"),
        F.when(F.col("role") == "assistant", F.length("body")).alias("reply"),
        F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
    )
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "segment", "reply", "end"))).alias("t"))
    replies = F.filter("t", lambda x: x["reply"].isNotNull())
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.segment"), "").alias("formatted"),
        F.transform(
            replies,
            lambda x: F.struct(
                (x["no"] - 1).alias("target"),
                (x["end"] - len(END) - x["reply"]).alias("loss_start"),
                (x["end"] - len(END)).alias("loss_end"),
                x["end"].alias("example_end"),
            ),
        ).alias("examples"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, target, text (the buffer up to the reply's end), loss_start, loss_end, whole.

    A conversation with turns after its last reply, or without replies, has one row
    more that holds all of it and nothing to train on (null target and mask).
    ``whole`` marks the one row of a conversation that reaches its end.
    """
    n = F.length("formatted").cast("long")
    none = F.lit(None)
    tail = F.struct(none.cast("int").alias("target"), none.cast("long").alias("loss_start"), none.cast("long").alias("loss_end"), n.alias("example_end"))
    reached = F.coalesce(F.element_at(F.transform("examples", lambda e: e["example_end"]), F.when(F.size("examples") > 0, -1)), F.lit(-1))
    rows = formatted.select("conv_id", "formatted", n.alias("n"), F.explode(F.when(reached == n, F.col("examples")).otherwise(F.concat("examples", F.array(tail)))).alias("e"))
    text = F.col("formatted").substr(F.lit(1), F.col("e.example_end").cast("int"))
    return rows.select("conv_id", "e.target", text.alias("text"), "e.loss_start", "e.loss_end", (F.col("e.example_end") == F.col("n")).alias("whole"))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return text.substr((start + 1).cast("int"), (end - start).cast("int"))


def materialize(formatted: DataFrame) -> DataFrame:
    """One row per example with its text and, apart, context and reply (escaped as in the text)."""
    return expand(formatted).filter("target is not null").select("conv_id", "target", "text", _cut(F.col("text"), F.lit(0), F.col("loss_start")).alias("context"), _cut(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the expanded examples say, read back from their texts: turns, the text under the loss masks and the size of each conversation.

    Every example is made and read by itself; what is brought together of it is its
    reply alone, so a conversation's rows grow with its text, not with its square.
    """
    part_role = lambda p: F.substring_index(p, "\n", 1)
    part_text = lambda p: unescape(p.substr(F.length(part_role(p)) + 2, F.length(p) - F.length(part_role(p)) - 1 - len(END)))

    def turns(parts: Column) -> Column:
        said = F.transform(parts, lambda p: F.concat(unescape_role(part_role(p)), F.lit("\n"), part_text(p), F.lit("\n")))
        return F.struct(F.size(parts).cast("long").alias("n"), F.sha2(F.array_join(said, ""), 256).alias("sha"))

    cut = F.split("text", r"<\|im_start\|>")
    back = F.transform(F.array(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))), turns)[0]
    read = expand(formatted).select(
        "conv_id",
        "target",
        F.when(F.col("target").isNotNull(), unescape(_cut(F.col("text"), F.col("loss_start"), F.col("loss_end")))).alias("reply"),
        F.when(F.col("target").isNotNull(), F.length("text").cast("long")).alias("size"),
        F.when(F.col("whole"), back).alias("turns"),
    )
    trained = F.when(F.col("target").isNotNull(), F.struct("target", "reply"))
    merged = read.groupBy("conv_id").agg(F.max("turns").alias("t"), F.collect_list(trained).alias("r"), F.coalesce(F.sum("size"), F.lit(0)).alias("formatted_chars"))
    loss = F.array_join(F.transform(F.array_sort("r"), lambda x: x["reply"]), "")
    sums = F.transform(F.array(loss), lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))[0]
    return merged.select("conv_id", F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"), sums.alias("l"), "formatted_chars").select("conv_id", "n_turns", "turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars")
