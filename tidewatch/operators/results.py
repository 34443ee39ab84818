"""Result rows: rates, upsert semantics, roll-ups, retention, alarms, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import SAMPLE_LAYOUT, alarm_text, ratio
from tidewatch.operators.ranks import grouped_percentiles
from tidewatch.operators.windows import group_by_window, sample_errors
from tidewatch.schemas import CRITICAL_LEVELS, RATE_ALERT, SCORE_ALERT
from tidewatch.session import settle

RESULT_KEY = ["timestamp", "window_start"]


def results_rates(results: DataFrame) -> DataFrame:
    return results.withColumns({
        "error_rate": F.when(F.col("log_count") > 0, ratio("error_count", "log_count")).otherwise(F.lit(0.0)),
        "critical_rate": F.when(F.col("log_count") > 0, ratio("critical_count", "log_count")).otherwise(F.lit(0.0)),
    })


def results_latest(results: DataFrame, arrival: str = "arrival", truth: str = "first") -> DataFrame:
    """Upsert semantics: the last write per key wins, the first ground truth stays.

    ``truth="last"`` lets the label follow too, as needed when one window is
    written again because it grew.

    One aggregation with map-side combine: a key written very often is reduced
    before it is shuffled, and no key's versions are collected.
    """
    if "ground_truth" not in results.columns:
        results = results.withColumn("ground_truth", F.lit(None).cast("int"))
    body = [c for c in results.columns if c not in (*RESULT_KEY, "ground_truth", arrival)]
    picked = results.groupBy(*RESULT_KEY).agg(
        F.max_by(F.struct(*body), F.col(arrival)).alias("_last"),
        (F.min_by if truth == "first" else F.max_by)("ground_truth", F.col(arrival)).alias("ground_truth"),
        F.max(arrival).alias(arrival),
    )
    return picked.select(*RESULT_KEY, "_last.*", "ground_truth", arrival)


SUMMARY_AGGS = lambda: [
    F.count(F.lit(1)).alias("total_windows"),
    F.sum("is_anomaly").alias("anomaly_count"),
    F.avg("anomaly_score").alias("avg_anomaly_score"),
    F.max("anomaly_score").alias("max_anomaly_score"),
    F.avg("error_rate").alias("avg_error_rate"),
    F.avg("critical_rate").alias("avg_critical_rate"),
]


def anomaly_summary_hourly(results: DataFrame) -> DataFrame:
    return group_by_window(results, SUMMARY_AGGS(), "1 hour").withColumnRenamed("timestamp", "bucket")


def within_dates(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Bound the partition column ``date``, where a stored table has one, so other dates are never read."""
    if "date" not in df.columns:
        return df
    if lo is not None:
        df = df.filter(F.col("date") >= F.to_date(lo))
    return df if hi is None else df.filter(F.col("date") <= F.to_date(hi))


def hourly_refresh(results: DataFrame, now, start_offset: str = "1 day", end_offset: str = "10 minutes") -> DataFrame:
    """Buckets wholly inside [now - start_offset, now - end_offset], recomputed.

    A stored table is bounded by its date partitions as well as by the key.
    """
    now = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    lo = F.date_trunc("hour", now - F.expr(f"INTERVAL {start_offset}") + F.expr("INTERVAL 1 hour") - F.expr("INTERVAL 1 microsecond"))
    hi = F.date_trunc("hour", now - F.expr(f"INTERVAL {end_offset}"))
    return anomaly_summary_hourly(within_dates(results, lo, hi).filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi)))


def retention(df: DataFrame, now, keep: str, ts: str = "timestamp") -> DataFrame:
    now = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    cutoff = now - F.expr(f"INTERVAL {keep}")
    return within_dates(df, cutoff).filter(F.col(ts) >= cutoff)


def range_by_flag(results: DataFrame, flag: int = 1) -> DataFrame:
    return results.filter(F.col("is_anomaly") == flag).orderBy(F.desc("timestamp"))


def range_by_start(results: DataFrame, start: str, end: str) -> DataFrame:
    key = F.col("window_start")
    return within_dates(results, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")).filter((key >= F.lit(start).cast("timestamp")) & (key < F.lit(end).cast("timestamp"))).orderBy("window_start")


def logs_by_level(logs: DataFrame, level: str) -> DataFrame:
    return logs.filter(F.col("level") == level).orderBy(F.desc("timestamp"))


def alert_on_score(results: DataFrame, threshold: float = SCORE_ALERT) -> DataFrame:
    return results.filter(F.col("anomaly_score") >= threshold)


def alert_on_rate(results: DataFrame, threshold: float = RATE_ALERT) -> DataFrame:
    hourly = group_by_window(results, [F.avg("is_anomaly").alias("anomaly_rate")], "1 hour")
    return hourly.filter(F.col("anomaly_rate") > threshold)


def alarm_lines(results: DataFrame, logs: DataFrame, width: str, samples: int = 3) -> DataFrame:
    """One alarm line per flagged window plus its first critical messages.

    Only the key of the flagged windows and the rank-limited samples meet in the
    join: at most ``samples`` rows per window on either side.
    """
    flagged = settle(results.filter(F.col("is_anomaly") == 1))
    heads = flagged.select("window_start", F.lit(0).alias("line_no"), alarm_text().alias("line"))
    picked = sample_errors(logs, width, samples)
    details = picked.join(flagged.select("window_start"), "window_start", "left_semi").select(
        "window_start", F.col("sample_no").alias("line_no"),
        F.format_string(SAMPLE_LAYOUT, F.col("sample_no"), F.col("message")).alias("line"))
    return heads.unionByName(details)


def alarm_lines_sampled(flagged: DataFrame) -> DataFrame:
    """``alarm_lines`` of flagged result rows that carry their first critical messages in ``samples``."""
    heads = flagged.select("window_start", F.lit(0).alias("line_no"), alarm_text().alias("line"))
    details = flagged.select("window_start", F.posexplode("samples").alias("at", "s")).select(
        "window_start", (F.col("at") + 1).alias("line_no"), F.format_string(SAMPLE_LAYOUT, F.col("at") + 1, F.col("s.message")).alias("line"))
    return heads.unionByName(details)


def pattern_rules(features: DataFrame, logs: DataFrame, width: str, flood: float = 10.0, silence: float = 0.1,
                  spike: float = 3.0, cascade_services: int = 3) -> DataFrame:
    """Named window patterns on the 12 features.

    Normal is the median log count (and critical count) of the same hour of
    day.  A cascade is critical logs from several services in one window.
    """
    features = settle(features)
    hour = F.hour("timestamp")
    base = None  # 24 rows: the medians come from positions in range partitions, no hour's values are gathered
    for column, name in (("log_count", "normal_count"), ("critical_count", "normal_critical")):
        part = grouped_percentiles(features.select(hour.alias("_hour"), column), "_hour", column, {name: 0.5})
        base = part if base is None else base.join(part, "_hour")
    # Distinct services per window in two map-side-combined steps.
    critical = group_by_window(logs.filter(F.col("level").isin(CRITICAL_LEVELS)), [F.count(F.lit(1)).alias("_n")], width, keys=["service"])
    services = critical.groupBy("timestamp").agg(F.count("service").alias("critical_services"))
    joined = (
        features.withColumn("_hour", hour).join(F.broadcast(base), "_hour").join(services, "timestamp", "left")
        .withColumn("critical_services", F.coalesce("critical_services", F.lit(0)))
    )
    flag = lambda c: c.cast("int")
    return joined.select(
        "timestamp", "log_count", "critical_count", "critical_services", "normal_count",
        flag((F.col("critical_count") > spike * F.col("normal_critical")) & (F.col("critical_rate") > 0.5)).alias("error_spike"),
        flag(F.col("log_count") >= flood * F.col("normal_count")).alias("log_flood"),
        flag(F.col("log_count") <= silence * F.col("normal_count")).alias("silent_failure"),
        flag(F.col("critical_services") >= cascade_services).alias("cascade"),
        flag(F.col("warn_to_info_ratio") > 1).alias("warning_storm"),
    )
