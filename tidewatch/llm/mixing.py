"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import word_count
from tidewatch.operators.ranks import running_total
from tidewatch.session import settle


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size): words per source; null is a source of its own.  Summed before the shuffle, so a hot source is one row per task."""
    return docs.select(F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size")).groupBy("source").agg(F.sum("size").alias("size"))


def cycle_weights(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """Add ``weight``: the given weights in turn over the sources by code point, null last."""
    ranked = running_total(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], out="_rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))).drop("_last", "_rank")


def set_targets(weighted: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size, weight) -> the same with ``target`` and ``rate`` = target / size.

    The targets add up to ``share`` of all sizes and follow the weights; a
    target stops at ``most`` times its source's size, and what is left over is
    shared by weight among the others until none is above.  Every round is one
    aggregate that returns one row; sources at their stop never leave it, so
    rounds end after at most one per source.  A source without words gets 0.
    """
    table = settle(weighted)
    stop = F.col("size") * F.lit(float(most))
    wanted = (table.agg(F.sum("size")).first()[0] or 0) * float(share)
    level, stopped = 0.0, -1
    while True:
        if stopped < 0:
            free = F.col("size") > 0
        else:
            free = (F.col("size") > 0) & (stop > F.lit(level) * F.col("weight"))
        n, held, weight = table.agg(
            F.sum((~free).cast("int")), F.sum(F.when(~free, stop).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        if n is None or n == stopped or not weight:
            level = level if weight or n is None else float("inf")
            break
        stopped, level = n, (wanted - held) / weight
    target = F.when(F.col("size") > 0, F.least(stop, F.lit(level) * F.col("weight"))).otherwise(0.0)
    return table.withColumn("target", target.cast("double")).withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0))


def draw_key(seed: int, *cols: Column) -> Column:
    """An MD5 of the seed and the values alone, as hex."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]).cast("binary"))


def draw(key: Column) -> Column:
    """A number in [0, 1): the first 52 bits of a key."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def number_equals(rows: DataFrame, key: str, tie: Column, out: str = "nth") -> DataFrame:
    """Add ``out``: 1, 2, ... among the rows of one ``key``, in the order of ``tie``.

    Keys are counted before anything moves, and only rows whose key is held
    twice or more are sorted, in ranges that part a key held by many rows.
    Rows with one tie are numbered as they lie.
    """
    again = settle(rows.groupBy(F.col(key).alias("_again")).count().filter("count > 1").select("_again"))
    if again.isEmpty():
        return rows.withColumn(out, F.lit(1).cast("long"))
    held = F.col(key) == F.col("_again")
    single = rows.join(again, held, "left_anti").withColumn(out, F.lit(1).cast("long"))
    repeated = rows.join(again, held, "left_semi").withColumn("_tie", tie).withColumn("_at", F.monotonically_increasing_id())
    placed = running_total(repeated, [key, "_tie", "_at"], out="_place")
    begin = placed.groupBy(F.col(key).alias("_begins")).agg(F.min("_place").alias("_begin"))
    numbered = placed.join(begin, F.col(key) == F.col("_begins")).withColumn(out, (F.col("_place") - F.col("_begin") + 1).cast("long"))
    return single.unionByName(numbered.select(*rows.columns, out))


def plan_mix(docs: DataFrame, targets: DataFrame, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` as a struct ``row``, with size, source_size, target and ``copies``.

    A document is emitted floor(rate) times, and once more with a probability
    of the fraction, drawn from (seed, doc_id, source, text), so reruns agree.
    Rows that agree in all of these share a draw and are numbered: n of them
    get the fraction's n-fold, rounded down or up by that draw, so a source
    of repeated rows meets its target too.  Which of them get the copies
    follows from their other columns (maps aside).  Null ids, sources and
    texts are values of their own; a text without words is taken at its
    source's rate as well.  ``targets`` has one row per source; its size is
    known from its files, so a small one is broadcast and a large one joined.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").alias("_from"),
        draw_key(seed, F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.md5(F.col(f"`{text}`").cast("binary"))).alias("_key"))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if f.name != text and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows = number_equals(rows, "_key", F.xxhash64(F.lit(seed), *plain), "_nth")
    rates = targets.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "rate")
    joined = rows.join(rates, F.col("_from").eqNullSafe(F.col("_source")))
    whole, u = F.floor("rate"), draw(F.col("_key"))
    upto = lambda n: F.ceil(n * (F.col("rate") - whole) - u)  # extra copies of the first n of equal rows
    return joined.select("row", "size", "source_size", "target", (whole + upto(F.col("_nth")) - upto(F.col("_nth") - 1)).cast("int").alias("copies"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, **names: str) -> DataFrame:
    """The mixed corpus: every document as often as ``plan_mix`` says, with its own columns."""
    rows = plan_mix(docs, targets, seed, **names).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
