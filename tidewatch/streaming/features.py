"""Continuous window features.  The aggregation code is the batch code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalar import nan_inf_to_zero
from tidewatch.operators.templates import with_template
from tidewatch.operators.textmodel import TextModel, embed, embed_rarely
from tidewatch.operators.results import SUMMARY_AGGS
from tidewatch.operators.windows import count_aggs, group_by_window, window_rates
from tidewatch.plans.features import mean_over, weighted_mode
from tidewatch.schemas import VOLUME_COLS, WINDOW_WIDTH
from tidewatch.session import ensure_utc, settle

WATERMARK = "1 minute"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """Replay a folder of Parquet files as a stream."""
    ensure_utc(spark)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_volume(logs: DataFrame, width: str = WINDOW_WIDTH, watermark: str = WATERMARK) -> DataFrame:
    """12 volume features plus the window's label and critical counts, one stateful aggregation."""
    aggs = [*count_aggs(), F.coalesce(F.max("is_anomaly"), F.lit(0)).alias("ground_truth")]
    counts = group_by_window(logs.withWatermark("timestamp", watermark), aggs, width)
    return window_rates(counts).select("timestamp", *VOLUME_COLS, "ground_truth")


def stream_features(logs: DataFrame, model: TextModel, width: str = WINDOW_WIDTH, watermark: str = WATERMARK) -> DataFrame:
    """All 30 features in one stateful aggregation.

    Features of the model's own templates are computed once, when the query
    starts, and joined; only logs of other templates are embedded one by one.
    All of it is stateless and runs before the shuffle.  Every aggregate is a
    sum, a count or an extreme, so that rows combine by hash on the map side.
    The message score uses the model's extremes, or the window's own where the
    model has none; either way the mean has a closed form, so no second pass is
    needed.
    """
    dims = [f"tfidf_{i}" for i in range(model.basis.shape[1])]
    known = settle(model.rarity.select("template", F.col("rarity").alias("message_rarity"), embed(model).alias("_known")))
    rows = with_template(logs.withWatermark("timestamp", watermark)).join(known, "template", "left")
    rows = rows.withColumn("_e", F.coalesce("_known", embed_rarely(model)))
    rows = rows.select(
        "timestamp", "level", "is_anomaly", F.lit(1).alias("_n"), F.coalesce("message_rarity", F.lit(1.0)).alias("message_rarity"),
        F.col("_e.cluster").alias("cluster"), F.col("_e.distance").alias("distance"), *[F.col("_e.embedding")[i].alias(c) for i, c in enumerate(dims)])
    low, high = (F.lit(x) for x in model.extremes) if model.extremes else (F.min("distance"), F.max("distance"))
    aggs = [
        *count_aggs(), F.coalesce(F.max("is_anomaly"), F.lit(0)).alias("ground_truth"), *mean_over(["message_rarity"]),
        ((F.avg("distance") - low) / (high - low + F.lit(1e-10))).alias("message_anomaly_score"),
        weighted_mode("cluster", len(model.centers)).alias("message_cluster"), *mean_over(dims)]
    windows = window_rates(group_by_window(rows, aggs, width))
    return nan_inf_to_zero(windows.select(
        "timestamp", *VOLUME_COLS, "message_rarity", "message_anomaly_score", "message_cluster", *dims, "ground_truth"))


def stream_summary_hourly(logs: DataFrame, width: str, score, flag, watermark: str = WATERMARK) -> DataFrame:
    """Window rows chained into the hourly roll-up inside one streaming query (append mode).

    ``score`` and ``flag`` are expressions over the window's volume features.
    """
    aggs = count_aggs()
    windows = logs.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", width).alias("w")).agg(*aggs)
    rows = window_rates(windows).withColumns({"anomaly_score": score, "is_anomaly": flag})
    hourly = rows.groupBy(F.window(F.window_time("w"), "1 hour").alias("h")).agg(*SUMMARY_AGGS())
    return hourly.select(F.col("h.start").alias("bucket"), *[c for c in hourly.columns if c != "h"])
