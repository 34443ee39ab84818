"""Euclidean silhouette, of all rows or of a repeatable sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, block_pairs, build_blocks, compare_rows
from tidewatch.operators.kernels import longs, matrix, sq_distances
from tidewatch.operators.profiles import sample_rows
from tidewatch.session import settle


def silhouette_values(points: DataFrame, id_col: str, vec_col: str, label_col: str, sample: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, label, silhouette) of all rows; only a ``sample`` size that the caller names reads fewer."""
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                         F.lit(1).cast("long").alias("weight"), F.col(label_col).cast("long").alias("tag"))
    rows = settle(sample_rows(rows, sample, "id") if sample else rows)
    space = build_blocks(rows, block_rows)
    dims = space.dims

    def kernel(frames):
        """Distance sums of every row to every label that the frame holds."""
        for pdf in frames:
            held: dict[int, tuple] = {}

            def add(node, ids, dist, groups, member):
                mine = held.setdefault(node, (longs(ids), {}))[1]
                for g, sums in zip(groups, (dist @ member).T):
                    mine[g] = mine[g] + sums if g in mine else sums

            for r in pdf.itertuples(index=False):
                d = np.sqrt(sq_distances(matrix(r.mat_a, dims), matrix(r.mat_b, dims)))
                if r.a == r.b:
                    np.fill_diagonal(d, 0.0)
                for node, ids, dist, tags in [(r.a, r.ids_a, d, r.tags_b)] + ([(r.b, r.ids_b, d.T, r.tags_a)] if r.a != r.b else []):
                    groups, code = np.unique(longs(tags), return_inverse=True)
                    add(node, ids, dist, groups.tolist(), np.eye(len(groups))[code])
            for ids, sums in held.values():
                yield pd.DataFrame({"id": np.tile(ids, len(sums)), "other": np.repeat(np.fromiter(sums, np.int64, len(sums)), len(ids)), "d": np.concatenate(list(sums.values()))})

    sums = (
        compare_rows(space, block_pairs(space, -1.0, float("inf")), space.packed, ["mat", "tags", "ids"], kernel, "id long, other long, d double")
        .groupBy("id", "other").agg(F.sum("d").alias("d")))
    sizes = rows.groupBy(F.col("tag").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    full = sums.join(sizes, "other").join(rows.select("id", "tag"), "id")
    own = F.col("other") == F.col("tag")
    per = full.groupBy("id", F.col("tag").alias("label")).agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    value = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return per.select("id", "label", F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), value).otherwise(F.lit(0.0)).alias("silhouette"))


def silhouette(points: DataFrame, id_col: str, vec_col: str, label_col: str, sample: int | None = None, **options) -> DataFrame:
    return silhouette_values(points, id_col, vec_col, label_col, sample, **options).agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("rows"))
