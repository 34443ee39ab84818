"""Connected components of an edge table, several graphs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.kernels import connect
from tidewatch.session import settle


FLUSH = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by stars around the smallest vertex of what they connect."""
    held: dict[int, np.ndarray] = {}  # graph -> stars (u, v)
    waiting, size = [], 0

    def contract() -> None:
        edges = np.concatenate(waiting)
        for s in np.unique(edges[:, 0]).tolist():
            u, v = edges[edges[:, 0] == s, 1:].T
            if s in held:
                u, v = np.concatenate([held[s][:, 0], u]), np.concatenate([held[s][:, 1], v])
            names, root = connect(u, v)
            held[s] = np.column_stack([names, root])[names != root]

    for batch in batches:
        waiting.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        size += len(waiting[-1])
        if size > FLUSH:
            contract()
            waiting, size = [], 0
    if size:
        contract()
    for s, stars in held.items():
        for start in range(0, len(stars), 10_000):
            part = stars[start:start + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), s), pa.int32()), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["s", "u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (s, u, v) -> (s, u, comp), comp = smallest vertex; isolated vertices are absent.

    Edges are first contracted within their partitions, so a graph of whatever
    density leaves each task as stars, fewer edges than vertices.  Alternating
    large-star / small-star rounds, each written to the shared folder, then run
    until the edge set is stable.
    """
    plain = edges.filter(F.col("u") != F.col("v")).select(F.col("s").cast("int"), F.col("u").cast("long"), F.col("v").cast("long"))
    e = settle(plain.mapInArrow(_contract, "s int, u long, v long").distinct())
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("s", "u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            stars = e.select("s", "u", F.col("v").alias("comp"))
            return stars.unionByName(stars.select("s", F.col("comp").alias("u"), "comp").distinct())
        seen = mark
        both = e.unionByName(e.select("s", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("s", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.filter(F.col("v") > F.col("u")).join(least, ["s", "u"])
            .select("s", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = settle(large)
        center = large.groupBy("s", "u").agg(F.min("v").alias("m"))
        moved = large.join(center, ["s", "u"]).filter(F.col("v") != F.col("m")).select("s", F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(moved.unionByName(center.withColumnRenamed("m", "v")).distinct())
