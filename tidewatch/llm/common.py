"""Column expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def content_key(*cols: Column) -> Column:
    """64-bit key of column values; nulls count as values of their own."""
    return F.xxhash64(*[part for c in cols for part in (c, c.isNull())])


def pack(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that working columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpack(df: DataFrame, columns: Iterable[str], added: dict[str, Column] | None = None, name: str = "row") -> DataFrame:
    """The columns of ``pack`` back, in order; ``added`` replaces columns of the same name or follows them."""
    added = dict(added or {})
    kept = [added.pop(c).alias(c) if c in added else F.col(f"{name}.`{c}`").alias(c) for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])
