"""Contiguous shards of nearly equal byte size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (a null text has none) plus one for its end mark."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def prefix_sums(rows: DataFrame, order: list[str], weight: str) -> tuple[DataFrame, int, int]:
    """Add ``start`` (weight before the row) and ``place`` (rows before it) in the global ``order``.

    Rows are range-partitioned and written once, so that their placement is
    decided once; each partition is summed on its own, and the totals, one row
    per partition, give every partition its base.  Returns the table, the
    weight of all rows and the largest weight.  Rows that agree in ``order``
    are told apart by their place in the input, so equal rows never pile up.
    """
    placed = settle(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(c) for c in order], F.col("_tie"))
        .withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max(weight).alias("_most"))
    # One row per partition: bounded by the shuffle width, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    total, most = parts.agg(F.sum("_sum"), F.max("_most")).first()
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    summed = (
        placed.withColumn("_in", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(bases), "_part")
        .withColumn("start", F.col("_base") + F.col("_in")).withColumn("place", F.col("_first") + F.col("_row")))
    return summed.drop("_part", "_tie", "_in", "_row", "_base", "_first"), total or 0, most or 0


def assign_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, digest, shard (from 0) and slot (gapless from 0 in each shard).

    Documents stand in the order of (text digest, doc_id), so equal texts are
    neighbours.  Shard j begins where the bytes before a document reach j
    equal parts of all bytes.  Where that cut falls into a run of equal texts,
    it moves to the nearer end of the run, unless the run is larger than the
    largest document: a large run is cut in the middle, so no shard is ever off
    by more than about one document.

    A null text counts as empty; a null doc_id comes first among equal texts;
    repeated rows keep one place each; an empty table gives no rows; other
    columns are not read.  With fewer bytes than shards some shards are empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), byte_size(F.col(f"`{text}`")).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("digest"))
    summed, total, most = prefix_sums(rows, ["digest", "doc_id"], "size")
    summed = settle(summed)
    cuts = [-(-j * total // shards) for j in range(shards + 1)]
    part = lambda at: F.expr(f"({at} * {shards}L) div {max(total, 1)}L")
    # Runs that hold a cut: fewer than there are shards.
    runs = (
        summed.groupBy("digest").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("end"))
        .filter((part("first") < part("end")) & (F.col("end") - F.col("first") <= most)))
    for first, end in runs.select("first", "end").collect():
        for j in range(1, shards):
            at = -(-j * total // shards)
            if first < at < end:
                near = first if at - first <= end - at else end
                if 2 * shards * abs(near - at) < total:  # cuts never pass each other
                    cuts[j] = near
    edges = F.array(*[F.lit(c).cast("long") for c in cuts[:-1]])
    guess = part("start").cast("int")
    edge = lambda j: F.element_at(edges, j + 1)
    shard = (
        F.when((guess > 0) & (F.col("start") < edge(guess)), guess - 1)
        .when((guess < shards - 1) & (F.col("start") >= edge(F.least(guess + 1, F.lit(shards - 1)))), guess + 1).otherwise(guess))
    placed = summed.withColumn("shard", shard.cast("int"))
    firsts = dict(placed.groupBy("shard").agg(F.min("place")).collect())  # at most one row per shard
    base = F.array(*[F.lit(firsts.get(j, 0)).cast("long") for j in range(shards)])
    return placed.select(
        "doc_id", "size", "text_crc32", "digest", "shard", (F.col("place") - F.element_at(base, F.col("shard") + 1)).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write whole documents to ``path``/shard=j.

    Documents find their shard by doc_id and text digest; rows that agree in
    both are spread over the shards that hold them by a number of their own.
    """
    placed = assign_shards(docs, shards, doc_id, text)
    homes = placed.groupBy("doc_id", "digest", "shard").agg(F.count(F.lit(1)).alias("n"))
    homes = homes.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("homes"))  # one entry per shard at most
    body = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("_id"), body.alias("_digest"))
    joined = keyed.join(homes, F.col("_id").eqNullSafe(homes.doc_id) & (F.col("_digest") == homes.digest))
    several = Window.partitionBy("_id", "_digest").orderBy(F.lit(1))
    single = joined.filter(F.size("homes") == 1).select("row", F.col("homes")[0]["shard"].alias("shard"))
    spread = joined.filter(F.size("homes") > 1).withColumn("_n", F.row_number().over(several)).select("row", F.aggregate(
        "homes", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("shard")),
        lambda a, h: F.struct((a["upto"] + h["n"]).alias("upto"), F.when((a["shard"] < 0) & (F.col("_n") <= a["upto"] + h["n"]), h["shard"]).otherwise(a["shard"]).alias("shard")),
        lambda a: a["shard"]).alias("shard"))
    out = single.unionByName(spread).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "shard"], "shard")
    out.write.partitionBy("shard").parquet(path)
