"""Parameter grids scored against labels, sharing the expensive part between settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.dbscan import dbscan_grid
from tidewatch.operators.evaluation import add_metrics, confusion_aggs
from tidewatch.operators.forest import fit_forest, forest_scores
from tidewatch.operators.hdbscan import hdbscan_grid
from tidewatch.operators.ranks import describe_columns
from tidewatch.session import settle

# The published grids.
DBSCAN_EPS_GRID = [2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 20.0]
DBSCAN_MIN_SAMPLES_GRID = [3, 5, 10, 15, 20]
CONTAMINATION_GRID = [0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.03, 0.05]
TREES_GRID = [50, 100, 150, 200]
MIN_CLUSTER_SIZE_GRID = [5, 10, 15, 20, 30, 50, 100]
HDBSCAN_MIN_SAMPLES_GRID = [1, 3, 5, 10, 15, 20]


def tune_dbscan(points: DataFrame, id_col: str, vec_col: str, truth_col: str, eps_values: Sequence[float] = DBSCAN_EPS_GRID,
                min_samples_values: Sequence[int] = DBSCAN_MIN_SAMPLES_GRID) -> DataFrame:
    """eps, min_samples, n_clusters, n_noise, noise_pct, precision, recall, f1_score.

    One neighbour search at the largest eps answers the whole grid.
    """
    settings = [(e, m) for e in eps_values for m in min_samples_values]
    labels = dbscan_grid(points, settings, id_col, vec_col)
    return grid_metrics(labels, points, id_col, truth_col, ["eps", "min_samples"], settings)


def tune_hdbscan(points: DataFrame, id_col: str, vec_col: str, truth_col: str, size_values: Sequence[int] = MIN_CLUSTER_SIZE_GRID,
                 min_samples_values: Sequence[int] = HDBSCAN_MIN_SAMPLES_GRID) -> DataFrame:
    """min_cluster_size, min_samples, n_clusters, n_noise, noise_pct, precision, recall, f1_score.

    One neighbour search for the grid, one spanning tree per min_samples.
    """
    settings = [(m, k) for m in size_values for k in min_samples_values]
    labels = hdbscan_grid(points, settings, id_col, vec_col)
    return grid_metrics(labels, points, id_col, truth_col, ["min_cluster_size", "min_samples"], settings)


def grid_metrics(labels: DataFrame, points: DataFrame, id_col: str, truth_col: str, names: Sequence[str], settings: Sequence[tuple]) -> DataFrame:
    """Cluster counts and metrics per setting, from (setting, id, label)."""
    truth = points.select(F.col(id_col).cast("long").alias("id"), F.col(truth_col).cast("int").alias("truth"))
    flagged = labels.join(truth, "id").withColumn("flag", (F.col("label") == -1).cast("int"))
    per_label = flagged.groupBy("setting", "label").agg(*confusion_aggs("truth", "flag"), F.count(F.lit(1)).alias("n"))
    cells = per_label.groupBy("setting").agg(
        F.count_if(F.col("label") != -1).cast("int").alias("n_clusters"), *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp", "n")])
    scored = add_metrics(cells, degenerate_zero=True)
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in settings])
    return scored.withColumn("_p", F.element_at(grid, F.col("setting") + 1)).select(
        *[F.col(f"_p.{n}").alias(n) for n in names], "n_clusters", (F.col("tp") + F.col("fp")).alias("n_noise"),
        ((F.col("tp") + F.col("fp")) * 100.0 / F.col("n")).alias("noise_pct"), "precision", "recall", "f1_score")


def tune_forest(points: DataFrame, id_col: str, vec_col: str, truth_col: str, contaminations: Sequence[float] = CONTAMINATION_GRID,
                tree_counts: Sequence[int] = TREES_GRID, seed: int = 42) -> DataFrame:
    """contamination, n_estimators, n_predicted, predicted_pct, precision, recall, f1_score.

    One forest of the largest size; smaller ones are its prefixes, and one
    scoring pass yields all of them.
    """
    tree_counts = sorted(tree_counts)
    forest = fit_forest(points, id_col, vec_col, trees=tree_counts[-1], seed=seed)
    scored = settle(points.select(
        F.col(truth_col).cast("int").alias("truth"), forest_scores(vec_col, forest, tree_counts).alias("s")))
    names = [f"s{i}" for i in range(len(tree_counts))]
    scored = scored.select("truth", *[F.col("s")[i].alias(n) for i, n in enumerate(names)])
    cuts = {r["metric"]: r for r in describe_columns(scored, names, {f"c{j}": c for j, c in enumerate(contaminations)}).collect()}
    flags = F.array(*[
        F.struct(F.lit(float(c)).alias("contamination"), F.lit(trees).alias("n_estimators"),
                 (F.col(n) < F.lit(cuts[n][f"c{j}"])).cast("int").alias("flag"))
        for n, trees in zip(names, tree_counts) for j, c in enumerate(contaminations)])
    out = scored.select("truth", F.explode(flags).alias("f")).select("truth", "f.*").groupBy("contamination", "n_estimators").agg(
        *confusion_aggs("truth", "flag"))
    predicted, total = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return add_metrics(out, degenerate_zero=True).select(
        "contamination", "n_estimators", predicted.alias("n_predicted"), (predicted * 100.0 / total).alias("predicted_pct"),
        "precision", "recall", "f1_score")
