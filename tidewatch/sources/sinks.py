"""Sinks.  Every write is idempotent, so a replayed micro-batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.results import RESULT_KEY, anomaly_summary_hourly, results_latest, results_rates
from tidewatch.schemas import RESULT_SCHEMA
from tidewatch.session import path_exists


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by_date(df: DataFrame, path: str, batch_id: int, ts: str = "timestamp") -> None:
    """Parquet partitioned by (date, batch); rewriting the same batch replaces only its own files.

    Rows are rebalanced by date: one file per ordinary date, several for a date
    that holds much of the batch.
    """
    dated = df.withColumns({"date": F.to_date(ts), "batch": F.lit(batch_id).cast("long")})
    (
        dated.hint("rebalance", "date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
    )


def upsert_results(batch: DataFrame, path: str, batch_id: int, arrival: str | None = None) -> None:
    """Upsert by (timestamp, window_start).

    Of rows with one key the last to arrive stays; without ``arrival`` a repeated
    key is an error.  Across batches the newest batch wins when the table is read.  Nothing is read back or rewritten, so the cost
    follows the batch, not the table.
    """
    if arrival:
        batch = results_latest(batch, arrival).drop(arrival)
    elif not batch.groupBy(*RESULT_KEY).count().filter("count > 1").isEmpty():
        raise ValueError("a batch with repeated keys needs the name of its arrival column")
    write_by_date(batch, path, batch_id)


def read_results(spark: SparkSession, path: str, truth: str = "first", dates: tuple[str, str] | None = None) -> DataFrame:
    """Current rows of an upserted table; ``dates`` (first, last) limits the partitions read."""
    stored = spark.read.parquet(path)
    if dates:
        stored = stored.filter(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    return results_latest(stored.drop("date"), "batch", truth).drop("batch")


def compact_results(spark: SparkSession, path: str, out: str, truth: str = "first", dates: tuple[str, str] | None = None) -> None:
    """Write the current rows (of ``dates``) as a single batch 0 at ``out``; ``truth`` as in ``read_results``: growing windows need "last"."""
    write_by_date(read_results(spark, path, truth, dates), out, 0)


def refresh_summary(spark: SparkSession, results_path: str, summary_path: str, truth: str = "first") -> int:
    """Bring the stored hourly summary up to date with an upserted result table; returns how many dates were rewritten.

    ``marks`` beside the summary names the last batch that it covers.  Only
    dates that later batches touched are read again, and only their partitions
    are overwritten; without such batches nothing is written at all.  The mark
    follows the summary, so a refresh that fails is simply done again.
    """
    stored = spark.read.parquet(results_path)
    marks = f"{summary_path}/marks"
    done = spark.read.parquet(marks).first()[0] if path_exists(spark, marks) else -1
    # Dates and batches are folder names: neither of these two reads opens a file.
    last = stored.agg(F.max("batch")).first()[0]
    if last is None or last <= done:
        return 0
    days = [r[0] for r in stored.filter(F.col("batch") > done).select("date").distinct().collect()]
    current = results_latest(stored.filter(F.col("date").isin(days)).drop("date"), "batch", truth)
    summary = anomaly_summary_hourly(current).withColumn("date", F.to_date("bucket"))
    summary.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{summary_path}/hours")
    spark.createDataFrame([(last,)], "batch long").coalesce(1).write.mode("overwrite").parquet(marks)
    return len(days)


def read_summary(spark: SparkSession, summary_path: str) -> DataFrame:
    return spark.read.parquet(f"{summary_path}/hours").drop("date")


def expire_partitions(dates: DataFrame, now: str, keep: str) -> DataFrame:
    """Dates whose partitions lie wholly before the retention cut-off."""
    cutoff = F.to_date(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {keep}"))
    return dates.filter(F.col("date") < cutoff)


def drop_expired(spark: SparkSession, path: str, now: str, keep: str) -> list[str]:
    """Delete the date folders of a stored table that lie wholly before the retention cut-off; returns their dates.

    The list of dates is read from the folder names, not from the rows.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {f.getPath().getName()[5:]: f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("date=")}
    if not folders:
        return []
    known = spark.createDataFrame([(d,) for d in folders], "name string").withColumn("date", F.col("name").cast("date"))
    gone = sorted(r.name for r in expire_partitions(known, now, keep).collect())
    for name in gone:
        fs.delete(folders[name], True)
    return gone


def write_alarms(lines: DataFrame, path: str) -> None:
    """Alarm text in window order (range-partitioned files)."""
    lines.orderBy("window_start", "line_no").select("line").write.mode("overwrite").text(path)


def encode_results(results: DataFrame, key: str = "window_start") -> DataFrame:
    """key/value text columns for a message broker, one JSON object per result."""
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") for c, t in results.dtypes if t == "timestamp"}
    return results.withColumns(iso).select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*results.columns)).alias("value"))


def decode_results(messages: DataFrame, value: str = "value") -> DataFrame:
    """Result messages -> stored result rows: decoded by the result schema, with error and critical rates."""
    return results_rates(messages.select(F.from_json(F.col(value).cast("string"), RESULT_SCHEMA).alias("r")).filter(F.col("r.window_start").isNotNull()).select("r.*"))


def publish_results(results: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of results to a broker topic (acks=all); needs the connector.  For use inside a micro-batch handler."""
    encode_results(results).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.retries", "3").save()
