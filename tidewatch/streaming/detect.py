"""Continuous detection: stateful features, stateless scoring, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.operators.latency import latency_stage_split
from tidewatch.operators.results import alarm_lines, results_rates
from tidewatch.plans.detect import DetectorModel, score_windows
from tidewatch.session import scratch_scope, session_settings
from tidewatch.sources.logs import decode_json_logs, split_corrupt
from tidewatch.sources.sinks import upsert_results, write_alarms, write_by_date
from tidewatch.streaming.features import WATERMARK, stream_features, stream_volume


class ProgressTotals(StreamingQueryListener):
    """Keeps (logs, updated rows, late rows) of every batch of every query of a session; a query itself keeps only its last reports."""

    def __init__(self):
        self.batches: dict[str, dict[int, tuple[int, int, int]]] = {}

    @staticmethod
    def of(progress) -> tuple[int, int, int]:
        ops = progress.stateOperators
        return (progress.numInputRows or 0, sum(op.numRowsUpdated for op in ops), sum(op.numRowsDroppedByWatermark for op in ops))

    def onQueryStarted(self, event):
        self.batches.setdefault(str(event.runId), {})

    def onQueryProgress(self, event):
        p = event.progress
        self.batches.setdefault(str(p.runId), {})[p.batchId] = self.of(p)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


_totals: dict[str, ProgressTotals] = {}


def progress_totals(spark: SparkSession) -> ProgressTotals:
    """The session's listener, attached on first use."""
    key = spark.sparkContext.applicationId
    if key not in _totals:
        _totals[key] = ProgressTotals()
        spark.streams.addListener(_totals[key])
    return _totals[key]


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update",
               every: str | None = None, state_partitions: int | None = None, settings: Mapping[str, str] | None = None) -> StreamingQuery:
    """Start a query that hands micro-batches to ``handle``.

    The number of state partitions is fixed for the life of a checkpoint; the
    default is one per core the cluster offers, whatever batch jobs use.
    ``settings`` are further session settings that the query needs.

    ``every`` = processing-time trigger; without it, what is available is
    drained and the query ends.  Offsets live in the checkpoint; a batch that
    fails is replayed under the same id, so handlers must be idempotent per id.
    """
    progress_totals(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    width = state_partitions or stream.sparkSession.sparkContext.defaultParallelism
    with session_settings(stream.sparkSession, {"spark.sql.shuffle.partitions": str(width), **(settings or {})}):
        return writer.start()  # the query runs in its own copy of the session


def result_rows(scored: DataFrame, features: DataFrame, width: str) -> DataFrame:
    """Result records: all times and counts are the window's own."""
    counts = features.select("timestamp", "log_count", "error_count", "critical_count", "ground_truth")
    rows = scored.join(counts, "timestamp").withColumns({
        "window_start": F.col("timestamp"), "window_end": F.col("timestamp") + F.expr(f"INTERVAL {width}")})
    return results_rates(rows)


def start_detection(logs: DataFrame, model: DetectorModel, width: str, results_path: str, checkpoint: str, watermark: str = WATERMARK,
                    every: str | None = None, raw_path: str | None = None, alarms_path: str | None = None, mode: str = "update",
                    publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """logs -> features -> stored scaler and core windows -> upserted results (and alarm text).

    ``update`` mode rewrites a window whenever it grows and leaves nothing open
    at shutdown; the upsert keeps one row per window.  ``publish`` gets each
    batch of results as well (for a topic: ``publish_results``).
    """
    features = stream_volume(logs, width, watermark) if model.text is None else stream_features(logs, model.text, width, watermark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            with scratch_scope(batch.sparkSession):
                results = result_rows(score_windows(batch, model), batch, width).persist()
                upsert_results(results, results_path, batch_id)
                if publish:
                    publish(results)
                if raw_path and alarms_path:
                    days = results.filter("is_anomaly = 1").select(F.to_date("timestamp").alias("date")).distinct()
                    raw = batch.sparkSession.read.parquet(raw_path).join(days, "date", "left_semi")
                    write_alarms(alarm_lines(results, raw, width), f"{alarms_path}/batch={batch_id}")
                results.unpersist()
        finally:
            batch.unpersist()

    return each_batch(features, handle, checkpoint, mode, every)


def start_raw_sink(logs: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Parsed logs to Parquet by date, one directory per batch."""
    return each_batch(logs, lambda batch, i: write_by_date(batch, path, i), checkpoint, "append", every)


def start_quarantine(raw: DataFrame, good_path: str, bad_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """JSON records: decodable ones to the raw table, the rest to quarantine; the query never stops on a bad record."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_corrupt(decode_json_logs(batch))
        write_by_date(good, good_path, batch_id)
        bad.write.mode("overwrite").text(f"{bad_path}/batch={batch_id}")

    return each_batch(raw, handle, checkpoint, "append", every)


def start_latency(logs: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Times per log for ``read_latency``; ``logs`` carries timestamp and ingest_time.

    The start is taken when the handler begins, the alert when the batch's rows
    have been written; both are stored once per batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        start = datetime.now(timezone.utc)
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        stamps = batch.sparkSession.createDataFrame([(start, datetime.now(timezone.utc))], "start_time timestamp, alert_time timestamp")
        stamps.write.mode("overwrite").parquet(f"{path}/stamps/batch={batch_id}")

    return each_batch(logs, handle, checkpoint, "append", every)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """Stage durations per log of what ``start_latency`` stored."""
    rows, stamps = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/stamps")
    return latency_stage_split(rows.join(stamps, "batch"))


def counters(query: StreamingQuery) -> dict[str, int]:
    """Totals of a finished or running query: input logs, emitted rows, rows dropped as late.

    Every batch counts, however many there were: the session's listener keeps
    them all, and the query's own last reports fill in what has not reached it.
    """
    batches = dict(progress_totals(SparkSession.active()).batches.get(str(query.runId), {}))
    for p in query.recentProgress:
        batches[p.batchId] = ProgressTotals.of(p)
    return {name: sum(b[k] for b in batches.values()) for k, name in enumerate(("logs", "windows_updated", "dropped_late"))}
