"""Chat formatting: conversations as one text with marked turns and a loss mask, and back again; Spark expressions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of this template: begin of a block, end of its role, between texts of one block, end of a block.
START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"
#: Strings that models read as control; none of them is left whole in a text (fixed values).
CONTROL = [START, SEP, PART, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of each control string: a lone one always means that."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(2 * ESCAPE))
    for mark in CONTROL:  # none is part of another, none begins or ends with a backslash
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _any(*marks: str) -> str:
    return "|".join(map(re.escape, marks))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: Sequence[str] = ("assistant",)
) -> DataFrame:
    """(conv, formatted, loss_mask): one row per conversation.

    Rows are sorted by (turn, role, text), nulls first as empty; equal rows stay
    rows of their own.  Adjacent rows of one role form a block, role once and
    texts kept apart by a mark of their own:
    ``<|im_start|>role<|im_sep|>text<|im_part|>text<|im_end|>``.  Texts and roles
    are escaped (see ``escape``).  ``loss_mask`` has an entry for each piece of
    the formatted text between marks, true for texts of the roles in
    ``trained``; marks themselves are never trained.  A null role or text is
    empty; null is a conversation like any other; a table without rows has
    none.  Other columns are not looked at.  A conversation is one value of
    the result and is put together in one task; it must fit in a row (2 GB).
    """
    shown = lambda c: escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    rows = turns.select(F.col(f"`{conv}`").alias("_conv"), F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), shown(role).alias("role_out"), shown(text).alias("text_out")).alias("row"))
    sorted_rows = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    row = lambda i: F.get("rows", i)
    first = lambda r, i: (i == 0) | (r["role"] != row(i - 1)["role"])
    begins = F.filter(F.transform("rows", lambda r, i: F.when(first(r, i), i)), lambda i: i.isNotNull())
    found = sorted_rows.select("_conv", "rows", begins.alias("begins"))
    merged = F.transform("begins", lambda b, k: F.struct(
        row(b)["role"].alias("role"), row(b)["role_out"].alias("role_out"),
        F.transform(F.sequence(b, F.coalesce(F.get("begins", k + 1), F.size("rows")) - 1), lambda i: row(i)["text_out"]).alias("texts")))
    blocks = found.select("_conv", merged.alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(START), b["role_out"], F.lit(SEP), F.array_join(b["texts"], PART), F.lit(END))), "")
    mask = F.flatten(F.transform("blocks", lambda b: F.concat(F.array(F.lit(False), F.lit(False)), F.array_repeat(b["role"].isin(*trained), F.size(b["texts"])))))
    return blocks.select(F.col("_conv").alias(conv), formatted.alias("formatted"), F.concat(mask, F.array(F.lit(False))).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, one for each row that went in; blocks and parts are taken apart."""
    blocks = F.filter(F.split(formatted, _any(END), -1), lambda b: b != "")
    parts = lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), _any(SEP), -1)
    turn = lambda p: F.transform(F.split(F.get(p, F.lit(1)), _any(PART), -1), lambda t: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(F.transform(blocks, parts), turn))


def read_trained(formatted: Column, mask: Column) -> Column:
    """What lies under the loss mask: array<string>, one for each trained text, in order."""
    pieces = F.split(formatted, _any(START, SEP, PART, END), -1)
    return F.transform(F.filter(pieces, lambda p, i: F.get(mask, i)), unescape)
