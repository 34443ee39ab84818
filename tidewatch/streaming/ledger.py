"""Windows kept in a table: every micro-batch adds its part, and nothing that arrives is lost.

A query over the raw logs hands its micro-batches to Spark's batch operators,
which combine on the map side; a flooded window is no hot state key.  A batch
writes, under its own number: the counts and first critical messages of the
windows it touches (``parts``), the logs that came too late for their window
(``late``), and how far event time has come (``marks``).  A replayed batch
rewrites the same folders, so totals stay right across failures and restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.results import alarm_lines_sampled
from tidewatch.operators.windows import count_aggs, roll_widths, rolling_stats, sample_errors, tumbling, width_micros, window_rates
from tidewatch.plans.detect import DetectorModel, score_windows
from tidewatch.schemas import COUNT_COLS, VOLUME_COLS
from tidewatch.session import delete_path, path_exists, scratch_scope, settle
from tidewatch.sources.sinks import read_results, upsert_results, write_alarms, write_by_date
from tidewatch.streaming.detect import each_batch, result_rows
from tidewatch.streaming.features import WATERMARK

SAMPLES = 3
SAMPLE = "array<struct<timestamp: timestamp, event_id: bigint, message: string>>"
LATE = "event_id long, timestamp timestamp, level string, service string, message string, is_anomaly int, anomaly_type string, window_start timestamp, date date, batch long"
PART = "timestamp timestamp, " + ", ".join(f"{c} long" for c in COUNT_COLS) + f", ground_truth int, samples {SAMPLE}, date date, batch long"


def window_parts(logs: DataFrame, width: str) -> DataFrame:
    """Counts, label and the first critical messages per window, of one batch of logs."""
    counts = tumbling(logs, width).groupBy(F.col("window_start").alias("timestamp")).agg(*count_aggs(), F.coalesce(F.max("is_anomaly"), F.lit(0)).alias("ground_truth"))
    return _with_samples(counts, sample_errors(logs, width, SAMPLES))


def _with_samples(windows: DataFrame, picked: DataFrame) -> DataFrame:
    """``windows`` with the picked messages (window_start, timestamp, event_id, message; at most SAMPLES each) as an array."""
    lists = picked.groupBy(F.col("window_start").alias("_w")).agg(F.sort_array(F.collect_list(F.struct("timestamp", "event_id", "message"))).alias("samples"))
    joined = windows.join(lists, F.col("timestamp") == F.col("_w"), "left").drop("_w")
    return joined.withColumn("samples", F.coalesce("samples", F.array().cast(SAMPLE)))


def read_windows(spark: SparkSession, path: str, only: DataFrame | None = None, days: Sequence | None = None) -> DataFrame:
    """Current windows (timestamp, counts, rates, ground_truth, samples); ``days`` limits the dates read, ``only`` (timestamp) also the windows.

    The dates of ``only`` pass through the driver: as many as a batch touches.
    """
    parts = spark.read.schema(PART).parquet(f"{path}/parts")
    if only is not None:
        days = [r[0] for r in only.select(F.to_date("timestamp")).distinct().collect()]
        parts = parts.join(only.select("timestamp").distinct(), "timestamp", "left_semi")
    if days is not None:
        parts = parts.filter(F.col("date").isin(list(days)))
    counts = parts.groupBy("timestamp").agg(*[F.sum(c).alias(c) for c in COUNT_COLS], F.max("ground_truth").alias("ground_truth"))
    known = parts.select(F.col("timestamp").alias("window_start"), F.explode("samples").alias("s"))
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy("timestamp", "event_id"))
    picked = known.select("window_start", "s.*").withColumn("_no", rank).filter(F.col("_no") <= SAMPLES)
    return window_rates(_with_samples(counts, picked))


def start_ledger(logs: DataFrame, width: str, path: str, checkpoint: str, watermark: str = WATERMARK, every: str | None = None,
                 on_windows: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the windows of a stream of logs at ``path``; ``on_windows`` gets the current state of the windows that a batch touched.

    A log is late when the mark that earlier batches reached, less ``watermark``,
    lies at or behind the end of its window (the rule of Spark's own windowed
    aggregates); it goes to ``late`` with the window it missed.  Every other log
    counts, so parts and late logs together hold all that arrived.
    """
    delay = width_micros(logs.sparkSession, watermark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/marks/batch={batch_id - 1}"
        mark = spark.read.parquet(before).first()[0] if path_exists(spark, before) else None
        batch = tumbling(batch, width).persist()
        try:
            missed = F.lit(False) if mark is None else F.unix_micros("window_end") <= F.lit(mark - delay)
            write_by_date(batch.filter(missed).drop("window_end"), f"{path}/late", batch_id, "window_start")
            fresh = batch.filter(~missed).drop("window_start", "window_end")
            write_by_date(window_parts(fresh, width), f"{path}/parts", batch_id)
            if on_windows:
                touched = fresh.select(F.window("timestamp", width)["start"].alias("timestamp")).distinct().persist()
                if not touched.isEmpty():
                    with scratch_scope(spark):
                        on_windows(read_windows(spark, path, touched), batch_id)
                touched.unpersist()
            reached = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
            reached = max((x for x in (mark, reached) if x is not None), default=None)
            spark.createDataFrame([(reached,)], "reached long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
            delete_path(spark, f"{path}/marks/batch={batch_id - 2}")
        finally:
            batch.unpersist()

    return each_batch(logs, handle, checkpoint, "append", every)


def start_ledger_detection(logs: DataFrame, judge: DetectorModel | Callable[[DataFrame], DataFrame], width: str, path: str, checkpoint: str,
                           watermark: str = WATERMARK, every: str | None = None, publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Results and alarms of a ledger's windows, at ``path``/results and ``path``/alarms.

    ``judge`` is a fitted detector on volume features, or a function that adds
    timestamp, is_anomaly, anomaly_score and cluster_label.  Alarms take their
    messages from the ledger itself: they need no other query and miss none
    that arrived before them.
    """
    if isinstance(judge, DetectorModel) and judge.text is not None:
        raise ValueError("a ledger holds volume features; use start_detection for a detector with a text model")
    score = (lambda windows: score_windows(windows, judge)) if isinstance(judge, DetectorModel) else judge

    def judged(windows: DataFrame, batch_id: int) -> None:
        windows = windows.persist()
        results = result_rows(score(windows.select("timestamp", *VOLUME_COLS)), windows, width).persist()
        upsert_results(results, f"{path}/results", batch_id)
        if publish:
            publish(results)
        flagged = results.filter("is_anomaly = 1").join(windows.select("timestamp", "samples"), "timestamp")
        write_alarms(alarm_lines_sampled(flagged), f"{path}/alarms/batch={batch_id}")
        results.unpersist()
        windows.unpersist()

    return start_ledger(logs, width, path, checkpoint, watermark, every, judged)


def rolling_updates(path: str, cols: Sequence[str], spans: Mapping[str, int], step_seconds: int) -> Callable[[DataFrame, int], None]:
    """``on_windows`` handler that keeps trailing statistics of a ledger's windows at ``path``/rolling.

    A window changes the statistics of the windows behind it, as far as the
    widest span; only these are computed again, from the history that they need.
    """
    reach = max(spans.values())
    chunk = lambda c: F.floor(F.unix_timestamp(c) / reach)

    def update(touched: DataFrame, batch_id: int) -> None:
        spark = touched.sparkSession
        first = touched.select(F.explode(F.array(chunk("timestamp"), chunk("timestamp") + 1)).alias("_chunk")).distinct()
        changed = settle(first)
        needed = settle(changed.select(F.explode(F.array(F.col("_chunk"), F.col("_chunk") - 1)).alias("_chunk")).distinct())
        day = lambda c: F.to_date(F.timestamp_seconds(c))
        span = F.sequence(day(F.col("_chunk") * reach), day((F.col("_chunk") + 1) * reach - 1))
        days = [r[0] for r in needed.select(F.explode(span)).distinct().collect()]
        history = read_windows(spark, path, days=days).withColumn("_chunk", chunk("timestamp")).join(needed, "_chunk", "left_semi")
        stats = rolling_stats(history, cols, spans, step_seconds).withColumn("_chunk", chunk("timestamp")).join(changed, "_chunk", "left_semi").drop("_chunk")
        upsert_results(stats.withColumn("window_start", F.col("timestamp")), f"{path}/rolling", batch_id)

    return update


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The logs that missed their window, with ``window_start``."""
    return spark.read.schema(LATE).parquet(f"{path}/late").drop("date", "batch")


def ledger_widths(spark: SparkSession, path: str, widths: Sequence[str]) -> DataFrame:
    """Counts at several widths, rolled up from the windows of a ledger: the stream is read and kept once, at the narrowest width."""
    return roll_widths(settle(read_windows(spark, path).select("timestamp", *COUNT_COLS)), widths)


def ledger_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: logs, windows, late and anomalies so far, from what is stored; batches that ran twice count once."""
    parts = spark.read.schema(PART).parquet(f"{path}/parts").groupBy("timestamp").agg(F.sum("log_count").alias("n"))
    totals = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("logs"), F.count(F.lit(1)).alias("windows"))
    late = read_late(spark, path).count()
    flagged = read_results(spark, f"{path}/results", "last").filter("is_anomaly = 1") if path_exists(spark, f"{path}/results") else None
    return totals.select("logs", "windows", F.lit(late).alias("late"), F.lit(flagged.count() if flagged is not None else 0).alias("anomalies"))
