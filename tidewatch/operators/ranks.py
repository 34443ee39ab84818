"""Exact global positions without a single-task sort.

Rows are range-partitioned by the sort key, each partition is numbered on its
own, and per-partition totals (one row per partition) give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle


def running_total(df: DataFrame, order: Sequence[str], weight: str | None = None, out: str = "upto") -> DataFrame:
    """Add the inclusive running sum of ``weight`` (default: row number) in ``order``.

    ``order`` should be unique, so that equal keys cannot straddle partitions.
    """
    placed = settle(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    )
    w = F.col(weight) if weight else F.lit(1)
    totals = placed.groupBy("_part").agg(F.sum(w).alias("_sum"))
    # One row per partition: bounded by the shuffle width, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_in", F.sum(w).over(inside)).join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")
    )


def describe_columns(df: DataFrame, cols: Sequence[str], points: dict[str, float]) -> DataFrame:
    """One row per column: metric, count, mean, std, min, max and exact percentiles ``{alias: p}``.

    One pass over ``df`` reduces it to (metric, value, count), so a hot value is
    one row; everything else is derived from that table.  Percentiles are
    linearly interpolated at position (n - 1) * p.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    hist = stacked.filter(F.col("v").isNotNull()).groupBy("metric", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = settle(running_total(hist, ["metric", "v"], "n"))
    total = F.sum("n")
    basic = ranked.groupBy("metric").agg(
        total.alias("count"), (F.sum(F.col("v") * F.col("n")) / total).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.min(F.col("upto") - F.col("n"))).alias("_base"))
    # One row per column: bounded by the width of the table.
    keyed = ranked.join(F.broadcast(basic), "metric")
    upto = F.col("upto") - F.col("_base")

    def at(position: Column) -> Column:
        return F.max(F.when((upto > position) & (upto - F.col("n") <= position), F.col("v")))

    place = {alias: (F.col("count") - 1) * F.lit(float(p)) for alias, p in points.items()}
    aggs = [F.sum(F.col("n") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("_ss")]
    for alias, k in place.items():
        aggs += [at(F.floor(k)).alias(f"{alias}_lo"), at(F.ceil(k)).alias(f"{alias}_hi")]
    row = keyed.groupBy("metric", "count", "mean", "min", "max").agg(*aggs)
    between = lambda a, k: (F.col(f"{a}_lo") + (k - F.floor(k)) * (F.col(f"{a}_hi") - F.col(f"{a}_lo"))).alias(a)
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1)))
    return row.select("metric", "count", "mean", std.alias("std"), "min", "max", *[between(a, k) for a, k in place.items()])


def grouped_percentiles(df: DataFrame, key: str, col: str, points: dict[str, float]) -> DataFrame:
    """(key, *points): exact percentiles of ``col`` per value of ``key``, linearly interpolated at (n - 1) * p.

    Rows are first reduced to (key, value, count); the positions of the values
    come from range partitions, so no key's values meet in one place however
    many there are.  Nulls in ``col`` do not count; a key without values is absent.
    """
    hist = df.select(F.col(key).alias("_k"), F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = settle(running_total(hist, ["_k", "_v"], "n"))
    ends = ranked.groupBy(F.col("_k").alias("_g")).agg(F.max("upto").alias("_end"), F.sum("n").alias("_all"))
    rows = ranked.join(ends, F.col("_k").eqNullSafe(F.col("_g")))
    upto = F.col("upto") - (F.col("_end") - F.col("_all"))  # position within the key
    at = lambda k: F.max(F.when((upto > k) & (upto - F.col("n") <= k), F.col("_v")))
    place = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in points.items()}
    picked = rows.groupBy("_k").agg(*[a for name, k in place.items() for a in (at(F.floor(k)).alias(f"{name}_lo"), at(F.ceil(k)).alias(f"{name}_hi"), F.first(k - F.floor(k)).alias(f"{name}_part"))])
    value = lambda name: F.col(f"{name}_lo") + F.col(f"{name}_part") * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
    return picked.select(F.col("_k").alias(key), *[value(name).alias(name) for name in points])


def percentile_table(df: DataFrame, col: str, points: dict[str, float]) -> DataFrame:
    """One row of exact percentiles of one column."""
    return describe_columns(df, [col], points).select(*points)
