"""Edges that the oracle does not see: widths, null levels, repeated keys, empty bursts, many batches, stored dates."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import profiles, results, silhouette, windows
from tidewatch.plans.incidents import inject_incidents
from tidewatch.session import fresh_path, shared_dir
from tidewatch.sources import sinks
from tidewatch.streaming import detect


def stamps(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp").alias("timestamp"), F.lit(1).cast("long").alias("log_count"))


@pytest.mark.parametrize("width,seconds", [("7 minutes", 420), ("45 seconds", 45), ("2 days", 172800), ("1 hour", 3600)])
def test_gap_fill_any_width(spark, logs, width, seconds):
    start = windows.first_midnight(logs, width)
    counts = windows.window_counts(logs, width, start)
    filled = windows.gap_fill(counts, width).select("timestamp", "log_count").orderBy("timestamp").collect()
    assert sum(r.log_count for r in filled) == logs.count()
    gaps = {(b.timestamp - a.timestamp).total_seconds() for a, b in zip(filled, filled[1:])}
    assert gaps <= {float(seconds)}
    first = logs.agg(F.date_trunc("day", F.min("timestamp"))).first()[0]
    assert (filled[0].timestamp - first).total_seconds() % seconds == 0


def test_gap_fill_refuses_other_grids(spark):
    with pytest.raises(ValueError):
        windows.gap_fill(stamps(spark, "2024-01-01 00:00:00", "2024-01-01 00:10:30"), "1 minute")
    assert windows.gap_fill(stamps(spark), "1 minute").count() == 0


def test_null_level_keeps_its_row(spark):
    rows = spark.createDataFrame([("INFO", 0), (None, 1), (None, 0)], "level string, is_anomaly int")
    got = {r.level: r.total for r in profiles.level_by_label_crosstab(rows).collect()}
    assert got == {"INFO": 1, None: 2, "All": 3}


def test_burst_sizes(spark, logs):
    spec = "incident_id long, timestamp timestamp, service string, kind string, size int, category string"
    at = logs.first().timestamp
    rows = [(1, at, "s", "spike", 0, "db"), (2, at, "s", "spike", 3, "db"), (3, at, "s", "cascade", 2, None)]
    plain = logs.drop("event_id")
    added = inject_incidents(plain, spark.createDataFrame(rows, spec)).filter(F.col("message").startswith("Injected"))
    assert sorted((r.anomaly_type, r["count"]) for r in added.groupBy("anomaly_type").count().collect()) == [("cascade_failure", 2), ("db_spike", 3)]


def result_batch(spark, *rows):
    return spark.createDataFrame(rows, "t string, score double, truth int, arrival int").select(
        F.col("t").cast("timestamp").alias("timestamp"), F.col("t").cast("timestamp").alias("window_start"), F.col("score").alias("anomaly_score"), F.col("truth").alias("ground_truth"), "arrival")


def test_repeated_keys_need_an_arrival(spark):
    batch = result_batch(spark, ("2024-01-01 00:00:00", 0.1, 0, 1), ("2024-01-01 00:00:00", 0.9, 1, 2))
    path = fresh_path(spark, "edge")
    with pytest.raises(ValueError):
        sinks.upsert_results(batch.drop("arrival"), path, 0)
    sinks.upsert_results(batch, path, 0, "arrival")
    assert sinks.read_results(spark, path).first().anomaly_score == 0.9


def test_compaction_follows_the_label_rule(spark):
    path, out = fresh_path(spark, "edge"), fresh_path(spark, "edge")
    for k, truth in enumerate((0, 1)):
        sinks.upsert_results(result_batch(spark, ("2024-01-01 00:00:00", 0.5, truth, 0)), path, k, "arrival")
    sinks.compact_results(spark, path, out, "last")
    assert sinks.read_results(spark, out, "last").first().ground_truth == 1


def test_expired_dates_are_deleted_and_ranges_pruned(spark):
    path = fresh_path(spark, "edge")
    sinks.write_by_date(result_batch(spark, *[(f"2024-01-{d:02d} 10:00:00", 0.5, 0, 0) for d in range(1, 11)]), path, 0)
    assert sinks.drop_expired(spark, path, "2024-01-10 12:00:00", "5 days") == [f"2024-01-{d:02d}" for d in range(1, 5)]
    stored = spark.read.parquet(path)
    assert stored.count() == 6
    plan = results.range_by_start(stored, "2024-01-06 00:00:00", "2024-01-07 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_silhouette_reads_all_rows(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], i % 2) for i in range(300)], "id long, vec array<double>, label int")
    assert silhouette.silhouette(rows, "id", "vec", "label").first().rows == 300
    assert silhouette.silhouette(rows, "id", "vec", "label", 50).first().rows == 50


def test_counters_of_many_batches(spark, monkeypatch):
    """The query's own reports are cut to the last few; the totals are not."""
    path = fresh_path(spark, "many")
    spark.range(60).repartition(30).selectExpr("id", "timestamp_seconds(id) AS timestamp").write.parquet(path)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        stream = spark.readStream.schema("id long, timestamp timestamp").option("maxFilesPerTrigger", 5).parquet(path)
        query = detect.each_batch(stream, lambda batch, i: batch.write.mode("overwrite").format("noop").save(), fresh_path(spark, "cp"), "append")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    import time

    for _ in range(50):
        if detect.counters(query)["logs"] == 60:
            break
        time.sleep(0.2)
    assert len(query.recentProgress) <= 3 and detect.counters(query)["logs"] == 60


def test_alert_is_later_than_start(spark):
    path, out = fresh_path(spark, "lat-in"), fresh_path(spark, "lat")
    spark.range(20).selectExpr("timestamp_seconds(id) AS timestamp", "current_timestamp() AS ingest_time").write.parquet(path)
    stream = spark.readStream.schema("timestamp timestamp, ingest_time timestamp").parquet(path)
    detect.start_latency(stream, out, fresh_path(spark, "cp")).awaitTermination()
    rows = detect.read_latency(spark, out).collect()
    assert len(rows) == 20 and all(r.start_to_alert_ms > 0 for r in rows)


def test_shared_folder_is_found(spark):
    assert shared_dir(spark)


def test_stream_leaves_no_scratch(spark, sf):
    """Tables settled for a micro-batch go with it."""
    import os

    from tidewatch.plans.detect import fit_detector
    from tidewatch.sources import logs as sources
    from tidewatch.streaming import features

    path, out = fresh_path(spark, "scratch-in"), fresh_path(spark, "scratch-out")
    spark.read.schema(sources.EVENT_SCHEMA).parquet(f"{sf}/events.parquet").repartition(6).write.parquet(path)
    model = fit_detector(sources.read_events(spark, sf), "6 hours", 1.4, 5)
    settled = lambda: {d for d, _, _ in os.walk(shared_dir(spark).removeprefix("file:")) if "/settled-" in d or "/scope-" in d}
    before = settled()
    stream = sources.events_as_logs(features.file_stream(spark, path, sources.EVENT_SCHEMA))
    detect.start_detection(stream, model, "6 hours", out, fresh_path(spark, "cp"), "60 days").awaitTermination()
    assert spark.read.parquet(out).select("batch").distinct().count() == 6
    assert settled() == before
