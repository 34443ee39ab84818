"""Isolation forest: trees from bounded hashed samples, scoring next to the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranks import percentile_table
from tidewatch.session import settle

# Defaults of the forest.
TREES, SAMPLE, SEED = 100, 256, 42
TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>, rows int"


def average_path(n) -> np.ndarray:
    """Mean unsuccessful search depth of a binary search tree with n keys."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(safe) + np.euler_gamma) - 2 * safe / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values(["h", "id"])["vec"].to_numpy())
        rng = np.random.default_rng((seed, tree))
        deepest = math.ceil(math.log2(max(len(x), 2)))
        feature, cut, left, right, size = [], [], [], [], []

        def node(rows, depth):
            at = len(feature)
            feature.append(-1); cut.append(0.0); left.append(-1); right.append(-1); size.append(len(rows))
            part = x[rows]
            spread = np.nonzero(part.max(0) > part.min(0))[0]
            if depth < deepest and len(rows) > 1 and len(spread):
                f = int(rng.choice(spread))
                c = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[at], cut[at] = f, float(c)
                left[at] = node(rows[part[:, f] <= c], depth + 1)
                right[at] = node(rows[part[:, f] > c], depth + 1)
            return at

        node(np.arange(len(x)), 0)
        return pd.DataFrame([(tree, feature, cut, left, right, size, len(x))], columns=["tree", "feature", "cut", "left", "right", "size", "rows"])

    return grow


def fit_forest(points: DataFrame, id_col: str, vec_col: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list:
    """Trees as plain node arrays (at most 2 * sample nodes each).

    A row offers itself to a tree only when its hash is below a threshold that
    lets about four times the sample through; the ``sample`` smallest hashes per
    tree are kept.  Repeatable, and no tree ever sees more than ``sample`` rows.
    """
    n = points.count()
    share = min(1.0, 4.0 * sample / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), t), F.lit(1 << 30)) / float(1 << 30)
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    takers = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    offers = rows.withColumn("tree", F.explode(takers))
    offers = offers.withColumn("h", F.xxhash64("id", F.lit(seed), "tree").bitwiseAND(F.lit((1 << 30) - 1)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", "id"))
    picked = offers.withColumn("_rn", rank).filter(F.col("_rn") <= sample).drop("_rn")
    grown = picked.groupBy("tree").applyInPandas(_grow(seed), TREE)
    return sorted(grown.collect(), key=lambda r: r["tree"])  # trees x 2 * sample nodes


def forest_scores(vec: Column | str, forest: list, prefixes: Sequence[int] | None = None) -> Column:
    """Array of score_samples values (lower = more anomalous), one per tree-count prefix."""
    prefixes = list(prefixes or [len(forest)])
    flat = [tuple(np.array(t[c]) for c in ("feature", "cut", "left", "right", "size")) for t in forest]
    norm = float(average_path(np.mean([t["rows"] for t in forest]))) or 1.0

    @F.pandas_udf("array<double>")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))
        total, out = np.zeros(len(x)), []
        lines = np.arange(len(x))
        for number, (feature, cut, left, right, size) in enumerate(flat, 1):
            at, depth = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[lines, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
                depth += inner
            total += depth + average_path(size[at])
            if number in prefixes:
                out.append(-np.power(2.0, -(total / number) / norm))
        return pd.Series(list(np.stack(out, axis=1)) if len(x) else [])

    return score(F.col(vec) if isinstance(vec, str) else vec)


def isolation_forest(points: DataFrame, id_col: str, vec_col: str, contamination: float, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = SEED) -> DataFrame:
    """(id, score, is_anomaly): flagged when the score lies below its exact contamination percentile."""
    points = settle(points.select(id_col, vec_col))  # read for the sample and for the scores
    forest = fit_forest(points, id_col, vec_col, trees, sample, seed)
    scored = settle(points.select(F.col(id_col).alias("id"), forest_scores(vec_col, forest)[0].alias("score")))
    cut = percentile_table(scored, "score", {"cut": contamination}).scalar()
    return scored.withColumn("is_anomaly", (F.col("score") < cut).cast("int"))
