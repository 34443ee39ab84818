"""Feature scaling, cluster centres and anomaly scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import noise_flag
from tidewatch.functions.vector import distance
from tidewatch.operators.coreindex import CoreIndex, build_core_index, nearest_cores
from tidewatch.session import settle

Scaler = Mapping[str, tuple[float, float]]


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """{column: (mean, population std)} from one aggregation; a constant column divides by one."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (float(row[f"m_{i}"] or 0.0), float(row[f"s_{i}"] or 0.0) or 1.0) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, cols))


def cluster_centers(rows: DataFrame, dims: int, label: str = "label", vec: str = "vec") -> DataFrame:
    """(label, center): mean vector per non-noise cluster; a hot cluster is pre-averaged on the map side."""
    means = [F.avg(F.col(vec)[i]).alias(f"c{i}") for i in range(dims)]
    out = rows.filter(F.col(label) != -1).groupBy(F.col(label).alias("label")).agg(*means)
    return out.select("label", F.array(*[f"c{i}" for i in range(dims)]).alias("center"))


def index_centers(centers: DataFrame) -> CoreIndex:
    return build_core_index(centers.select(F.col("center").alias("vec"), "label"))


def raw_scores(rows: DataFrame, centers: DataFrame, id_col: str = "id", vec: str = "vec", label: str = "label", index: CoreIndex | None = None) -> DataFrame:
    """Distance to the own centre; noise rows: to the nearest centre, 1.0 when there is none.

    One way for any number of centres: clustered rows meet their own by label,
    noise rows look up theirs in a block index of the centres (``index``, where
    one is stored).
    """
    own = rows.filter(F.col(label) != -1).join(centers.select(F.col("label").alias("_own"), "center"), F.col(label) == F.col("_own"))
    own = own.withColumn("raw_score", distance(F.col(vec), F.col("center"))).select(*rows.columns, "raw_score")
    noise = rows.filter(F.col(label) == -1)
    near = nearest_cores(noise, index or index_centers(centers), id_col, vec).select(F.col("id").alias("_near"), F.col("distance").alias("raw_score"))
    far = noise.join(near, F.col(id_col) == F.col("_near"), "left").withColumn("raw_score", F.coalesce("raw_score", F.lit(1.0)))
    return own.unionByName(far.select(*rows.columns, "raw_score"))


def anomaly_score(rows: DataFrame, dims: int, id_col: str = "id", vec: str = "vec", label: str = "label",
                  fitted_max: float | None = None, centers: DataFrame | None = None, index: CoreIndex | None = None) -> DataFrame:
    """Add ``anomaly_score`` in [0, 1]: raw score over the batch maximum, or over a stored one (clipped)."""
    centers = settle(cluster_centers(rows, dims, label, vec)) if centers is None else centers
    scored = raw_scores(rows, centers, id_col, vec, label, index)
    if fitted_max is None:
        scored = settle(scored)
        top = scored.agg(F.max("raw_score")).first()[0] or 0.0
    else:
        top = fitted_max
    scale = float(top) if top > 0 else 1.0
    return scored.withColumn("anomaly_score", F.least(F.col("raw_score") / F.lit(scale), F.lit(1.0))).drop("raw_score")


def predict_with_confidence(rows: DataFrame, dims: int, id_col: str = "id", vec: str = "vec", label: str = "label", **options) -> DataFrame:
    """timestamp-keyed predictions: is_anomaly, anomaly_score, cluster_label."""
    scored = anomaly_score(rows, dims, id_col, vec, label, **options)
    return scored.withColumns({"is_anomaly": noise_flag(label), "cluster_label": F.col(label)})


def cluster_noise_stats(rows: DataFrame, label: str = "label") -> DataFrame:
    """Number of clusters, noise rows and noise share; labels are counted once each before the final step."""
    per = rows.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    noise = F.coalesce(F.sum(F.when(F.col("_l") == -1, F.col("_n"))), F.lit(0))
    return per.agg(F.count_if(F.col("_l") != -1).alias("n_clusters"), noise.alias("n_noise"),
                   (noise * 100.0 / F.sum("_n")).alias("noise_pct"))
