"""Registry, shared inputs and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import ensure_utc
from tidewatch.sources.logs import read_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def present(df: DataFrame) -> DataFrame:
    """Output form of every query: doubles to 6 places, timestamps without zone."""
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = (F.round(c, DIGITS) + F.lit(0.0)).alias(name)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz").alias(name)
        shown.append(c)
    return df.select(*shown)


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return present(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, sf_dir)


LOGS = r"""logs AS (
  SELECT event_id, ts AS timestamp,
    CASE WHEN event_type = 'error' AND value >= 60 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
    'svc-' || CAST(user_id % 7 AS VARCHAR) AS service,
    CASE event_type
      WHEN 'view' THEN 'GET /api/items/' || CAST(user_id % 50 AS VARCHAR) || ' served to user_' || CAST(user_id AS VARCHAR)
      WHEN 'click' THEN 'Cache lookup key cache_' || regexp_extract(props, '(\d+)', 1)
      WHEN 'signup' THEN 'Slow call ' || CAST(event_id % 500 AS VARCHAR) || 'ms from 10.0.' || CAST(user_id % 256 AS VARCHAR) || '.7'
      WHEN 'purchase' THEN 'Payment accepted amount ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
      ELSE 'Upstream db-' || CAST(user_id % 5 AS VARCHAR) || ' timeout code '
           || chr(CAST(65 + CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 26 AS INTEGER)) END AS message,
    CASE WHEN event_type = 'error' AND value >= 150 THEN 1 ELSE 0 END AS is_anomaly,
    CASE WHEN event_type = 'error' AND value >= 150 THEN 'spike' END AS anomaly_type
  FROM events)"""

TEMPLATES = r""", tlogs AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(message), '\d+', '<NUM>', 'g'), '/[\w/]+', '<PATH>', 'g'),
         '^\s+|\s+$', '', 'g') AS template FROM logs)"""


def volume_sql(width: str, name: str = "vol", source: str = "logs", digits: int | None = 6) -> str:
    """CTEs ``{name}_n`` (counts) and ``{name}`` (12 features)."""
    r = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    counts = ", ".join(f"count(*) FILTER (level = '{lv.upper()}') AS {lv}_count" for lv in ("error", "fatal", "warn", "info", "debug"))
    return f""", {name}_n AS (
  SELECT time_bucket(INTERVAL '{width}', timestamp) AS timestamp, count(level) AS log_count, {counts} FROM {source} GROUP BY 1),
{name} AS (
  SELECT *, {r('error_count / greatest(log_count, 1)')} AS error_rate, {r('fatal_count / greatest(log_count, 1)')} AS fatal_rate,
    {r('warn_count / greatest(log_count, 1)')} AS warn_rate, {r('warn_count / greatest(info_count, 1)')} AS warn_to_info_ratio,
    error_count + fatal_count AS critical_count, {r('(error_count + fatal_count) / greatest(log_count, 1)')} AS critical_rate
  FROM {name}_n)"""
