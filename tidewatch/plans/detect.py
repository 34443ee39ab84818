"""Batch detection: logs in, flagged and scored windows out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import nan_inf_to_zero, noise_flag
from tidewatch.functions.vector import assemble
from tidewatch.operators.coreindex import CoreIndex, build_core_index, copy_core_index, open_core_index, probe_cores
from tidewatch.operators.dbscan import core_points, dbscan_fit, dbscan_model
from tidewatch.operators.scoring import Scaler, anomaly_score, apply_scaler, cluster_centers, fit_scaler, index_centers, raw_scores
from tidewatch.operators.templates import template_counts
from tidewatch.operators.textmodel import TextModel, load_text_model, save_text_model, with_extremes
from tidewatch.operators.windows import volume_features
from tidewatch.plans.features import all_features
from tidewatch.schemas import DBSCAN_EPS, DBSCAN_MIN_SAMPLES, VOLUME_COLS, WINDOW_WIDTH
from tidewatch.session import settle


@dataclass
class DetectorModel:
    """What serving needs: scaler, index of the core windows, centres, score scale and, optionally, the text model."""

    cols: list[str]
    scaler: Scaler
    cores: CoreIndex
    centers: DataFrame    # label, center
    center_index: CoreIndex
    score_max: float
    eps: float
    min_samples: int
    text: TextModel | None = None


def features_for(logs: DataFrame, text: TextModel | None, width: str) -> DataFrame:
    return all_features(logs, text, width) if text is not None else nan_inf_to_zero(volume_features(logs, width))


def scaled_vectors(features: DataFrame, scaler: Scaler) -> DataFrame:
    """(id, timestamp, vec): id is the window's own time, so row order is time order."""
    vec = assemble(apply_scaler(features, scaler), list(scaler))
    return vec.select(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("id"), "timestamp", "vec")


def detect_features(features: DataFrame, cols: Sequence[str], eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Scale, cluster and score a feature table: timestamp, is_anomaly, anomaly_score, cluster_label."""
    features = settle(features)
    rows = scaled_vectors(features, fit_scaler(features, cols))
    labels = dbscan_fit(rows, eps, min_samples, "id", "vec")
    scored = anomaly_score(settle(rows.join(labels, "id")), len(cols))
    return scored.select("timestamp", noise_flag("label").alias("is_anomaly"), "anomaly_score", F.col("label").alias("cluster_label"))


def detect_batch(logs: DataFrame, width: str = WINDOW_WIDTH, eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES,
                 text: TextModel | None = None) -> DataFrame:
    features = features_for(logs, text, width)
    return detect_features(features, [c for c in features.columns if c != "timestamp"], eps, min_samples)


def fit_detector(logs: DataFrame, width: str = WINDOW_WIDTH, eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES,
                 text: TextModel | None = None) -> DetectorModel:
    if text is not None and text.extremes is None:
        text = with_extremes(text, settle(template_counts(logs)))
    features = settle(features_for(logs, text, width))
    cols = [c for c in features.columns if c != "timestamp"]
    scaler = fit_scaler(features, cols)
    rows = settle(scaled_vectors(features, scaler))
    fitted = settle(dbscan_model(rows, eps, min_samples, "id", "vec"))
    centers = settle(cluster_centers(fitted, len(cols)))
    nearest = index_centers(centers)
    top = raw_scores(fitted, centers, index=nearest).agg(F.max("raw_score")).first()[0] or 1.0
    return DetectorModel(cols, scaler, build_core_index(core_points(fitted)), centers, nearest, float(top), eps, min_samples, text)


def score_windows(features: DataFrame, model: DetectorModel) -> DataFrame:
    """Flag and score new windows against the stored model, without refitting."""
    rows = settle(scaled_vectors(features.select("timestamp", *model.cols), model.scaler))
    labels = probe_cores(rows, model.cores, model.eps, "id", "vec")
    scored = anomaly_score(settle(rows.join(labels, "id")), len(model.cols), fitted_max=model.score_max, centers=model.centers, index=model.center_index)
    return scored.select("timestamp", noise_flag("label").alias("is_anomaly"), "anomaly_score", F.col("label").alias("cluster_label"))


def save_detector(model: DetectorModel, path: str) -> None:
    spark = model.centers.sparkSession
    copy_core_index(spark, model.cores, f"{path}/cores")
    copy_core_index(spark, model.center_index, f"{path}/center-index")
    model.centers.write.mode("overwrite").parquet(f"{path}/centers")
    body = {"cols": model.cols, "scaler": {c: list(v) for c, v in model.scaler.items()}, "score_max": model.score_max,
            "eps": model.eps, "min_samples": model.min_samples, "text": model.text is not None}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/detector")
    if model.text is not None:
        save_text_model(model.text, f"{path}/text-model")


def load_detector(spark: SparkSession, path: str) -> DetectorModel:
    body = json.loads(spark.read.text(f"{path}/detector").first()[0])
    return DetectorModel(
        body["cols"], {c: tuple(v) for c, v in body["scaler"].items()}, open_core_index(spark, f"{path}/cores"),
        spark.read.parquet(f"{path}/centers"), open_core_index(spark, f"{path}/center-index"), body["score_max"], body["eps"], body["min_samples"],
        load_text_model(spark, f"{path}/text-model") if body["text"] else None)
