"""Log profiles: distributions, calendars, data quality, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import round_pct
from tidewatch.operators.ranks import describe_columns
from tidewatch.operators.windows import gap_fill, group_by_window
from tidewatch.schemas import CRITICAL_LEVELS
from tidewatch.session import settle

# Calendar order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and share (%) per value."""
    counts = settle(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", F.col("count") * 100.0 / total)


def level_by_label_crosstab(logs: DataFrame) -> DataFrame:
    """level x label counts with row and column totals ("All"); a null level keeps its own row."""
    return (
        logs.rollup("level").agg(
            F.count_if(F.col("is_anomaly") == 0).alias("normal"),
            F.count_if(F.col("is_anomaly") == 1).alias("anomaly"),
            F.count("is_anomaly").alias("total"), F.grouping("level").alias("_all"),
        ).withColumn("level", F.when(F.col("_all") == 1, "All").otherwise(F.col("level"))).drop("_all")
    )


def filter_label(logs: DataFrame, label: int) -> DataFrame:
    return logs.filter(F.col("is_anomaly") == label)


def filter_critical(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level").isin(CRITICAL_LEVELS))


def filter_expected_errors(logs: DataFrame) -> DataFrame:
    """Critical level, yet not labelled anomalous."""
    return filter_critical(filter_label(logs, 0))


def anomaly_type_distribution(logs: DataFrame) -> DataFrame:
    return filter_label(logs, 1).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))


def daily_stats(logs: DataFrame) -> DataFrame:
    per_day = logs.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("is_anomaly").alias("total_logs"), F.sum("is_anomaly").alias("anomalies"))
    return per_day.withColumn("anomaly_pct", round_pct(F.col("anomalies") / F.col("total_logs") * 100))


def class_balance(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_anomaly") == 0).alias("normal"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalous"),
        (F.avg("is_anomaly") * 100).alias("anomaly_rate_pct"),
    )


def hourly_profile(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def weekday_profile(logs: DataFrame) -> DataFrame:
    """Monday-first counts; a weekday without logs keeps a null count."""
    counts = logs.groupBy(F.weekday("timestamp").alias("_d")).agg(F.count(F.lit(1)).alias("count"))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    days = logs.sparkSession.range(len(WEEKDAYS)).select(
        F.col("id").cast("int").alias("day_no"), F.element_at(names, (F.col("id") + 1).cast("int")).alias("day_of_week"))
    return days.join(counts, days.day_no == counts["_d"], "left").select("day_no", "day_of_week", "count")


def hourly_volume(logs: DataFrame) -> DataFrame:
    """Logs per clock hour, empty hours included."""
    return gap_fill(group_by_window(logs, [F.count(F.lit(1)).alias("count")], "1 hour"), "1 hour")


def peak_hours(logs: DataFrame, n: int = 3) -> DataFrame:
    return hourly_profile(logs).orderBy(F.desc("count"), "hour").limit(n)


def missing_values(df: DataFrame) -> DataFrame:
    """Null count and share per column, only columns that have any."""
    nulls = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        nulls.unpivot("_rows", df.columns, "column_name", "missing_count").filter(F.col("missing_count") > 0)
        .select("column_name", "missing_count", (F.col("missing_count") * 100.0 / F.col("_rows")).alias("percentage"))
    )


def feature_quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of missing (null or NaN) and infinite cells."""
    missing = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in cols), F.lit(0))
    infinite = sum((F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf"))) for c in cols), F.lit(0))
    return df.agg(missing.alias("missing_cells"), infinite.alias("infinite_cells"))


def dataset_summary(logs: DataFrame) -> DataFrame:
    """Size, span, services, levels and missing cells; logs are first reduced to (level, service) rows."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in logs.columns), F.lit(0))
    per = logs.groupBy("level", "service").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), nulls.alias("missing"))
    return per.agg(
        F.sum("n").alias("total_logs"), F.min("lo").alias("first_log"), F.max("hi").alias("last_log"),
        F.count_distinct("service").alias("n_services"),
        F.array_join(F.array_sort(F.collect_set("level")), ", ").alias("levels"),
        F.sum("missing").alias("missing_cells"),
    )


def score_describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, max, quartiles; exact, one pass over the rows."""
    return describe_columns(df, [col], {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("metric")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, repeatable: the smallest digests win (top-n per task, then merged)."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def sort_by_time(logs: DataFrame) -> DataFrame:
    return logs.orderBy("timestamp", "event_id")


def head_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
