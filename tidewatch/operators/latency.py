"""Latency statistics over probe measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ranks import describe_columns
from tidewatch.schemas import MAX_LATENCY_SECONDS


def latency_percentiles(measures: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, p95, p99, min, max per measure, linear interpolation, exact, one pass for all measures."""
    stats = describe_columns(measures, cols, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return stats.select("metric", "mean", "median", "p95", "p99", "min", "max")


def latency_sla_check(stats: DataFrame, metric: str, limit_seconds: float = MAX_LATENCY_SECONDS) -> DataFrame:
    """avg, p95 and p99 against the limit, with the margin left."""
    row = stats.filter(F.col("metric") == metric)
    cols = {"avg": "mean", "p95": "p95", "p99": "p99"}
    out = row.select(
        "metric",
        *[(F.col(c) / 1000).alias(f"{k}_seconds") for k, c in cols.items()],
        *[(F.col(c) / 1000 < limit_seconds).cast("int").alias(f"{k}_ok") for k, c in cols.items()],
        *[(F.lit(limit_seconds) - F.col(c) / 1000).alias(f"{k}_margin") for k, c in cols.items()],
    )
    return out.withColumn("all_ok", F.col("avg_ok") * F.col("p95_ok") * F.col("p99_ok"))


def alarm_rate(measures: DataFrame) -> DataFrame:
    return measures.agg(
        F.count_if("alarm_logged").alias("alarms_logged"), F.count(F.lit(1)).alias("total"),
        (F.avg(F.col("alarm_logged").cast("int")) * 100).alias("alarm_rate_pct"))


def latency_stage_split(rows: DataFrame) -> DataFrame:
    """Durations (ms) between event, ingest, start and alert times of each row."""
    ms = lambda c: F.unix_micros(F.col(c)) / 1000.0
    return rows.withColumns({
        "event_to_ingest_ms": ms("ingest_time") - ms("timestamp"),
        "ingest_to_start_ms": ms("start_time") - ms("ingest_time"),
        "start_to_alert_ms": ms("alert_time") - ms("start_time"),
    })
