"""Conversations as training text, by Spark expressions only.

Turn structs are collected per conversation and sorted, adjacent turns of one role are
merged by an array aggregation, and blocks are concatenated:

    [INST] role ([/INST] text)+ </s>

without the spaces. A merged block keeps its turns apart by ``[/INST]``. Control strings
inside roles and texts get a backslash after their first character and backslashes are
doubled, so that ``turns`` reads back what ``format_chats`` was given. The loss mask
lists the spans of assistant texts, in code points from 0.

Cases: null role or text is the empty one; turns of equal number are ordered by role and
text, repeated rows stay; rows without conversation id form one conversation; without
rows there is no conversation. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, BREAK, CLOSE, "<s>")
ESCAPED = tuple(c[0] + "\\" + c[1:] for c in CONTROL)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), zip(CONTROL, ESCAPED, strict=True), doubled)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), zip(CONTROL, ESCAPED, strict=True), text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role."""

    def add(blocks, turn):
        last = F.try_element_at(blocks, F.lit(-1))
        grown = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = last["role"] == turn["role"]
        return F.when(
            F.coalesce(same, F.lit(False)), F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(grown))
        ).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.lit([]).cast("array<struct<role:string,texts:array<string>>>"), add)


def _mask(blocks: Column, role: str) -> Column:
    """Spans (start, length) of the texts of ``role``, by lengths of what stands before."""

    def text(state, t, learn):
        start = state["at"] + len(BREAK)
        span = F.struct(start.cast("int").alias("start"), F.length(t).cast("int").alias("length"))
        spans = F.when(learn, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + F.length(t)).cast("int").alias("at"), spans.alias("spans"))

    def block(state, b):
        head = state["at"] + len(OPEN) + F.length(b["role"])
        inner = F.struct(head.cast("int").alias("at"), state["spans"].alias("spans"))
        done = F.aggregate(b["texts"], inner, lambda s, t: text(s, t, b["role"] == escape(F.lit(role))))
        return F.struct((done["at"] + len(CLOSE)).cast("int").alias("at"), done["spans"].alias("spans"))

    start = F.struct(
        F.lit(0).cast("int").alias("at"), F.lit([]).cast("array<struct<start:int,length:int>>").alias("spans")
    )
    return F.aggregate(blocks, start, block)["spans"]


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row (conv, formatted, loss_mask) per conversation."""
    row = F.struct(
        F.col(turn).alias("turn"),
        escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    sorted_turns = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    blocks = sorted_turns.select(conv, _merged(F.col("_turns")).alias("_blocks"))
    rendered = F.transform(
        "_blocks",
        lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(BREAK), F.array_join(b["texts"], BREAK), F.lit(CLOSE)),
    )
    return blocks.select(conv, F.array_join(rendered, "").alias("formatted"), _mask(F.col("_blocks"), learn).alias("loss_mask"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def texts(b):
        parts = F.split(b, r"\[/INST\]")
        role = unescape(F.substr(F.element_at(parts, 1), F.lit(len(OPEN) + 1)))
        return F.transform(
            F.slice(parts, F.lit(2), F.size(parts)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, texts))


def learnt(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, in order."""
    spans = F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
    return F.array_join(spans, "")
