"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply under
the loss mask.  A conversation that doesn't end with an assistant turn has one more example without a target,
so that the output holds every turn.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn.  Inside roles and texts every backslash is
doubled, and a backslash breaks each control string after its first character; reading back takes the
character after a backslash as it is, so any text comes back unchanged.

All rows of a conversation meet in one row, since the last example's context is the whole conversation; the
examples themselves are exploded and never held together.

Defined cases: null texts and roles are empty; rows go by turn, then role and text (null turns first), so
repeated turns keep a fixed order; rows with a null conversation id form one conversation; other columns of the
input are ignored; a very long text is repeated in every later example of its conversation, as the method asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# How the control strings of public chat templates begin or read.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, target, last, formatted, loss_start, loss_end) of every example.

    ``target`` is the trainable turn's place in its conversation, from 1 (null: none), ``last`` marks the
    conversation's longest example, and the loss mask covers the characters [loss_start, loss_end) of ``formatted``.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(t):
        head = F.concat(F.lit(START), escaped(t.role), F.lit(SEP))
        body = escaped(t.text)
        return F.struct((t.role == target_role).alias("own"), F.length(head).alias("head"), F.length(body).alias("body"),
                        F.concat(head, body, F.lit(END)).alias("text"))

    convs = convs.select("conv_id", F.transform("turns", segment).alias("segs"))
    n = F.size("segs")
    own = F.filter(F.transform("segs", lambda s, i: F.when(s.own, i + 1)), lambda i: i.isNotNull())
    ends = F.when(F.element_at("segs", -1).own, own).otherwise(F.concat(own, F.array(n)))
    at = F.element_at("segs", F.col("end"))
    out = convs.select("conv_id", "segs", F.explode_outer(ends).alias("end"))
    out = out.select(
        "conv_id", F.size("segs").alias("n_turns"), F.when(at.own, F.col("end")).alias("target"),
        (F.col("end") == F.size("segs")).alias("last"), at.body.alias("body"),
        F.array_join(F.transform(F.slice("segs", 1, F.col("end")), lambda s: s.text), "").alias("formatted"))
    stop = F.length("formatted") - len(END)
    return out.select("conv_id", "n_turns", "target", "last", "formatted",
                      F.when(F.col("target").isNotNull(), stop - F.col("body")).alias("loss_start"),
                      F.when(F.col("target").isNotNull(), stop).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds."""
    def turn(piece):
        halves = F.split(piece, r"<\|im_sep\|>", 2)
        return F.struct(unescaped(F.substr(F.get(halves, F.lit(0)), F.lit(len(START) + 1))).alias("role"),
                        unescaped(F.get(halves, F.lit(1))).alias("text"))

    pieces = F.split(formatted, r"<\|im_end\|>")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped; empty without a target."""
    return F.coalesce(unescaped(F.substr(formatted, start + 1, end - start)), F.lit(""))
