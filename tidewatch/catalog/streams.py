"""Streaming queries: the event table replayed as files, run to the end, result read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import LOGS, TEMPLATES, logs_of, query, volume_sql
from tidewatch.schemas import TEXT_COLS
from tidewatch.catalog.logs import MULTI, ROLL_SPANS, _rolling_sql
from tidewatch.catalog.models import SCORED, VOLUME_COLS, WEPS, WINDOWS, WNEED, dbscan_sql
from tidewatch.catalog.results import ALARMS, RES, SUMMARY, WIDTH, results_of
from tidewatch.catalog.text import all_features_sql, set_model
from tidewatch.operators import evaluation as E
from tidewatch.operators.ranks import describe_columns
from tidewatch.operators.scoring import fit_scaler
from tidewatch.operators.windows import window_labels
from tidewatch.plans import detect as P
from tidewatch.plans import tuning
from tidewatch.session import fresh_path, settle
from tidewatch.sources import logs as src
from tidewatch.sources import sinks
from tidewatch.streaming import detect as SD
from tidewatch.streaming import features as SF
from tidewatch.streaming import ledger as LG
from tidewatch.streaming import state as ST

FILES, LONG = 3, "60 days"
FILE_ROWS = 200_000  # events for each file of an arrival


def replay(spark, sf, key=None, parts=FILES, name="replay"):
    """Write the events as ``parts`` arrivals in a given order, to be opened as a stream."""
    path = fresh_path(spark, name)
    for i in range(parts):
        add_file(spark, sf, path, i, key, parts)
    return path


def add_file(spark, sf, path, i, key=None, parts=FILES):
    """Add arrival ``i``: one file, or with more than FILE_ROWS events in the table several, equally many for each arrival."""
    events = spark.read.schema(src.EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    key = F.col("event_id") % parts if key is None else key
    files, rows = -(-events.count() // FILE_ROWS), events.filter(key == i)
    (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    spark.range(1, numPartitions=1).select(F.lit(max(files, 1)).alias("files")).write.mode("ignore").parquet(f"{path}-files")


def arrivals(spark, path):
    """The events as a stream: a micro-batch takes the files of one arrival."""
    files = spark.read.schema("files int").parquet(f"{path}-files").first()[0]
    if len(spark.read.schema(src.EVENT_SCHEMA).parquet(path).inputFiles()) % files:
        raise ValueError(f"an arrival has too few events for {files} files")
    return SF.file_stream(spark, path, src.EVENT_SCHEMA, files)


def opened(spark, path):
    return src.events_as_logs(arrivals(spark, path))


def keep(path):
    """Handler: store the updated windows of each batch; the newest version wins on read."""
    return lambda batch, i: sinks.upsert_results(batch.withColumn("window_start", F.col("timestamp")), path, i)


def stored(spark, path, cols):
    return sinks.read_results(spark, path, "last").select(*cols)


VCOLS = ["timestamp", *VOLUME_COLS]
GT = ", g AS (SELECT time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, max(is_anomaly) AS ground_truth FROM logs GROUP BY 1)"


@query("stream_features", f"WITH {LOGS}{volume_sql('1 hour')}{GT} SELECT vol.*, ground_truth FROM vol JOIN g USING (timestamp)")
def stream_features(spark, sf):
    """Interleaved replay, update mode: the upserted result equals the batch result."""
    out = fresh_path(spark, "stream-features")
    features = SF.stream_volume(opened(spark, replay(spark, sf)), "1 hour", LONG)
    SD.each_batch(features, keep(out), fresh_path(spark, "cp")).awaitTermination()
    return stored(spark, out, [*VCOLS, "ground_truth"])


@query("drain_on_stop", f"WITH {LOGS}{volume_sql('30 seconds')} SELECT count(*) AS windows, CAST(sum(log_count) AS BIGINT) AS logs, max(timestamp) AS last_window FROM vol")
def drain_on_stop(spark, sf):
    """Nothing stays open: the last windows are there although no later data closes them."""
    out = fresh_path(spark, "drain")
    features = SF.stream_volume(opened(spark, replay(spark, sf, parts=1)), "30 seconds")
    SD.each_batch(features, keep(out), fresh_path(spark, "cp")).awaitTermination()
    return stored(spark, out, VCOLS).agg(F.count(F.lit(1)).alias("windows"), F.sum("log_count").alias("logs"), F.max("timestamp").alias("last_window"))


@query("resume", f"WITH {LOGS}{volume_sql('1 hour')} SELECT * FROM vol")
def resume(spark, sf):
    """Two files, stop, a third file, restart from the same checkpoint."""
    out, cp, path = fresh_path(spark, "resume"), fresh_path(spark, "cp"), fresh_path(spark, "replay")
    for stage in ([0, 1], [2]):
        for i in stage:
            add_file(spark, sf, path, i)
        SD.each_batch(SF.stream_volume(opened(spark, path), "1 hour", LONG), keep(out), cp).awaitTermination()
    return stored(spark, out, VCOLS)


LATE = "event_id % 50 = 0"


@query("late_data", f"WITH {LOGS}, kept AS (SELECT * FROM logs WHERE NOT ({LATE})){volume_sql('1 hour', source='kept')} SELECT * FROM vol")
def late_data(spark, sf):
    """Ten-day files in time order; some logs arrive two files late, past the watermark, and must not reopen a window."""
    part = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10)
    arrival = F.when(F.expr(LATE), part + 3).otherwise(part)
    out = fresh_path(spark, "late")
    features = SF.stream_volume(opened(spark, replay(spark, sf, arrival, parts=6)), "1 hour", "1 hour")
    SD.each_batch(features, keep(out), fresh_path(spark, "cp")).awaitTermination()
    return stored(spark, out, VCOLS)


@query("stream_all_features", all_features_sql(per_window=True))
def stream_all_features(spark, sf):
    """All 30 features from one stateful aggregation."""
    out = fresh_path(spark, "stream-all")
    features = SF.stream_features(opened(spark, replay(spark, sf)), set_model(logs_of(spark, sf)), "1 hour", LONG)
    SD.each_batch(features, keep(out), fresh_path(spark, "cp")).awaitTermination()
    return sinks.read_results(spark, out, "last").drop("window_start")


@query("stream_detect", f"WITH RECURSIVE {LOGS}{WINDOWS}{dbscan_sql(WEPS, WNEED)}{SCORED.replace('65', str(len(VOLUME_COLS) + 1))}{GT}, "
       "o AS (SELECT make_timestamp(id) AS timestamp, CAST(label = -1 AS INTEGER) AS is_anomaly, round(raw / max(raw) OVER (), 6) AS anomaly_score, label AS cluster_label FROM rw) "
       "SELECT timestamp, timestamp + INTERVAL 1 HOUR AS window_end, is_anomaly, anomaly_score, cluster_label, log_count, critical_count, ground_truth FROM o JOIN vol USING (timestamp) JOIN g USING (timestamp)")
def stream_detect(spark, sf):
    """Stored model applied to the stream: same flags and scores as the batch fit on the same windows."""
    out = fresh_path(spark, "detect")
    model = P.fit_detector(logs_of(spark, sf), "1 hour", WEPS, WNEED)
    SD.start_detection(opened(spark, replay(spark, sf, parts=2)), model, "1 hour", out, fresh_path(spark, "cp"), LONG).awaitTermination()
    return stored(spark, out, ["timestamp", "window_end", "is_anomaly", "anomaly_score", "cluster_label", "log_count", "critical_count", "ground_truth"])


@query("snk_raw_logs", f"WITH {LOGS} SELECT event_id, timestamp, level, service, message FROM logs")
def snk_raw_logs(spark, sf):
    out = fresh_path(spark, "raw")
    SD.start_raw_sink(opened(spark, replay(spark, sf)), out, fresh_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "timestamp", "level", "service", "message")


# The last hours stay open in append mode: an hour is out once the watermark has passed its end.
@query("stream_summary_hourly", f"""WITH {LOGS}{volume_sql('10 minutes', digits=None)}, wm AS (SELECT time_bucket(INTERVAL '1 hour', max(timestamp) - INTERVAL 1 MINUTE) AS t FROM logs)
 SELECT time_bucket(INTERVAL '1 hour', timestamp) AS bucket, count(*) AS total_windows, count(*) FILTER (critical_rate >= 0.5) AS anomaly_count,
 round(avg(critical_rate), 6) AS avg_anomaly_score, round(max(critical_rate), 6) AS max_anomaly_score, round(avg(error_rate), 6) AS avg_error_rate,
 round(avg(critical_rate), 6) AS avg_critical_rate FROM vol, wm WHERE timestamp < wm.t GROUP BY 1""")
def stream_summary_hourly(spark, sf):
    """Window aggregate chained into the hourly one, append mode, one query."""
    out = fresh_path(spark, "hourly")
    stream = SF.stream_summary_hourly(opened(spark, replay(spark, sf, parts=1)), "10 minutes", F.col("critical_rate"), (F.col("critical_rate") >= 0.5).cast("int"))
    handle = lambda batch, i: sinks.write_by_date(batch, out, i, "bucket")
    SD.each_batch(stream, handle, fresh_path(spark, "cp"), "append").awaitTermination()
    return spark.read.parquet(out).drop("date", "batch")


@query("throughput_counters", "SELECT count(*) AS logs, 0 AS dropped_late FROM events")
def throughput_counters(spark, sf):
    """Totals from the query's own progress reports."""
    out = fresh_path(spark, "count")
    q = SD.each_batch(SF.stream_volume(opened(spark, replay(spark, sf)), "1 hour", LONG), keep(out), fresh_path(spark, "cp"))
    q.awaitTermination()
    total = SD.counters(q)
    return spark.createDataFrame([(total["logs"], total["dropped_late"])], "logs long, dropped_late int")


@query("latency_stage_split")
def latency_stage_split(spark, sf):
    """p50 and p95 per stage; the file's modification time stands for the ingest time."""
    out, path = fresh_path(spark, "latency"), replay(spark, sf)
    stream = arrivals(spark, path)
    stamped = stream.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("_metadata.file_modification_time").alias("ingest_time"))
    SD.start_latency(stamped, out, fresh_path(spark, "cp")).awaitTermination()
    stages = ["event_to_ingest_ms", "ingest_to_start_ms", "start_to_alert_ms"]
    stats = describe_columns(SD.read_latency(spark, out), stages, {"p50": 0.5, "p95": 0.95})
    return stats.select(F.col("metric").alias("stage"), "p50", "p95")


# ---- detection on all 30 features ---------------------------------------------------------------

TEPS30, TNEED30 = 4.0, 5
ALL_COLS = [*VOLUME_COLS, *TEXT_COLS]
UNROUNDED = all_features_sql().replace("round(", "(").replace(", 6)", ")")  # features as they are, not as they are shown
TEXT_WINDOWS = f"WITH RECURSIVE af AS MATERIALIZED ({UNROUNDED}), v AS MATERIALIZED (SELECT epoch_us(timestamp) AS id, [" + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END" for c in ALL_COLS) + "] AS vec FROM af)"
TEXT_DETECTED = f"{TEXT_WINDOWS}{dbscan_sql(TEPS30, TNEED30)}{SCORED.replace('65', str(len(ALL_COLS) + 1))} "
TEXT_COLUMNS = "SELECT make_timestamp(id) AS timestamp, CAST(label = -1 AS INTEGER) AS is_anomaly, round(raw / max(raw) OVER (), 6) AS anomaly_score, label AS cluster_label FROM rw"


@query("detect_batch_text", TEXT_DETECTED + TEXT_COLUMNS)
def detect_batch_text(spark, sf):
    logs = logs_of(spark, sf)
    return P.detect_batch(logs, "1 hour", TEPS30, TNEED30, set_model(logs))


@query("model_load_text", TEXT_DETECTED + TEXT_COLUMNS)
def model_load_text(spark, sf):
    """A detector with its text model, saved, read back and applied to a batch."""
    logs, path = logs_of(spark, sf), fresh_path(spark, "detector")
    P.save_detector(P.fit_detector(logs, "1 hour", TEPS30, TNEED30, set_model(logs)), path)
    model = P.load_detector(spark, path)
    return P.score_windows(P.features_for(logs, model.text, "1 hour"), model)


@query("stream_detect_text", TEXT_DETECTED + TEXT_COLUMNS)
def stream_detect_text(spark, sf):
    """The stored model with its text model on the stream: the features, flags and scores of the batch."""
    out, logs = fresh_path(spark, "detect"), logs_of(spark, sf)
    model = P.fit_detector(logs, "1 hour", TEPS30, TNEED30, set_model(logs))
    SD.start_detection(opened(spark, replay(spark, sf, parts=2)), model, "1 hour", out, fresh_path(spark, "cp"), LONG).awaitTermination()
    return stored(spark, out, ["timestamp", "is_anomaly", "anomaly_score", "cluster_label"])


# ---- the published density grid on the windows' 30 features -------------------------------------

def _grid_sql() -> str:
    settings = [(e, m) for e in tuning.DBSCAN_EPS_GRID for m in tuning.DBSCAN_MIN_SAMPLES_GRID]
    labs = "".join(dbscan_sql(e, m, tag=str(i)) for i, (e, m) in enumerate(settings))
    rows = " UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS eps, {m} AS min_samples, label, truth FROM lab{i} JOIN tr USING (id)" for i, (e, m) in enumerate(settings))
    rate = lambda top, low: f"round(CASE WHEN n_noise IN (0, n) OR {low} = 0 THEN 0 ELSE {top} / ({low}) END, 6)"
    return f"""{TEXT_WINDOWS}, tr AS (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS id, max(CASE WHEN event_type = 'error' AND value >= 150 THEN 1 ELSE 0 END) = 1 AS truth FROM events GROUP BY 1){labs},
 al AS ({rows}),
 g AS (SELECT eps, min_samples, CAST(count(DISTINCT label) FILTER (label <> -1) AS INTEGER) AS n_clusters, count(*) FILTER (label = -1) AS n_noise, count(*) AS n,
   count(*) FILTER (label = -1 AND truth) AS tp, count(*) FILTER (label = -1 AND NOT truth) AS fp, count(*) FILTER (label <> -1 AND truth) AS fn FROM al GROUP BY 1, 2)
 SELECT eps, min_samples, n_clusters, n_noise, round(n_noise * 100.0 / n, 6) AS noise_pct, {rate('tp', 'tp + fp')} AS precision, {rate('tp', 'tp + fn')} AS recall,
  {rate('2 * tp', '2 * tp + fp + fn')} AS f1_score FROM g"""


def _published(spark, sf):
    """All 35 published settings from one neighbour search."""
    logs = logs_of(spark, sf)
    features = settle(P.features_for(logs, set_model(logs), "1 hour"))
    rows = P.scaled_vectors(features, fit_scaler(features, ALL_COLS))
    truth = window_labels(logs, "1 hour").select("timestamp", (F.col("is_anomaly") == 1).alias("truth"))
    return tuning.tune_dbscan(settle(rows.join(truth, "timestamp")), "id", "vec", "truth")


RANKED = f"SELECT * FROM ({_grid_sql()}) ORDER BY f1_score DESC, eps, min_samples LIMIT "
GRID_HEAT = ["f1_score", "precision", "recall", "noise_pct"]


@query("tune_grid_published", _grid_sql())
def tune_grid_published(spark, sf):
    return _published(spark, sf)


@query("top_configs_published", RANKED + "5")
def top_configs_published(spark, sf):
    """The five best of the published settings."""
    return E.top_configs(settle(_published(spark, sf)), ["eps", "min_samples"])


@query("best_config_published", RANKED + "1")
def best_config_published(spark, sf):
    return E.best_config(settle(_published(spark, sf)), ["eps", "min_samples"])


@query("pivot_tuning_published", "SELECT min_samples, " + ", ".join(
    f"max({m}) FILTER (eps = {e}) AS {m}_{str(e).replace('.', '_')}" for e in tuning.DBSCAN_EPS_GRID for m in GRID_HEAT) + f" FROM ({_grid_sql()}) GROUP BY 1")
def pivot_tuning_published(spark, sf):
    """The published grid as a table, 5 x 7 settings for each metric."""
    return E.pivot_tuning(settle(_published(spark, sf)), "min_samples", "eps", tuning.DBSCAN_EPS_GRID, GRID_HEAT)


# ---- first sightings, the window ledger, refreshed summaries, several widths ----------------------

FIRST_SQL = f"WITH {LOGS}{TEMPLATES} SELECT template, event_id, timestamp{{more}} FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY timestamp, event_id) AS rn FROM tlogs) WHERE rn = 1"


def _sightings(spark, sf, key=None, watermark=None):
    out = fresh_path(spark, "sightings")
    ST.start_first_sightings(opened(spark, replay(spark, sf, key)), out, fresh_path(spark, "cp"), watermark).awaitTermination()
    return out


@query("stream_first_seen", FIRST_SQL.format(more=""))
def stream_first_seen(spark, sf):
    """Interleaved replay: earlier logs that arrive late correct the first sighting."""
    return ST.read_first_sightings(spark, _sightings(spark, sf)).select("template", "event_id", "timestamp")


@query("stream_first_seen_final", FIRST_SQL.format(more=", true AS final"))
def stream_first_seen_final(spark, sf):
    """Files in time order and a watermark: timers make every sighting final."""
    days = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10)
    return ST.read_first_sightings(spark, _sightings(spark, sf, days, "1 hour")).select("template", "event_id", "timestamp", "final")


@query("stream_new_templates", f"""WITH {LOGS}{TEMPLATES}, f AS (SELECT template, min(timestamp) AS timestamp FROM tlogs GROUP BY 1)
 SELECT time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, count(*) AS new_templates FROM f GROUP BY 1""")
def stream_new_templates(spark, sf):
    return ST.new_templates_stored(spark, _sightings(spark, sf))


def _late_arrival():
    part = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10)
    return F.when(F.expr(LATE), part + 3).otherwise(part)


@query("late_data_kept", f"""WITH {LOGS} SELECT 'window' AS kind, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, count(*) AS n FROM logs WHERE NOT ({LATE}) GROUP BY ALL
 UNION ALL SELECT 'late', time_bucket(INTERVAL '1 hour', timestamp), count(*) FROM logs WHERE {LATE} GROUP BY ALL""")
def late_data_kept(spark, sf):
    """Windows and late logs together hold every log that arrived."""
    out = fresh_path(spark, "ledger")
    LG.start_ledger(opened(spark, replay(spark, sf, _late_arrival(), parts=6)), "1 hour", out, fresh_path(spark, "cp"), "1 hour").awaitTermination()
    windows = LG.read_windows(spark, out).select(F.lit("window").alias("kind"), "timestamp", F.col("log_count").alias("n"))
    late = LG.read_late(spark, out).groupBy(F.col("window_start").alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    return windows.unionByName(late.select(F.lit("late").alias("kind"), "timestamp", "n"))


def by_rate(windows):
    """Flag and score by rule: the critical rate."""
    return windows.select("timestamp", (F.col("critical_rate") >= 0.5).cast("int").alias("is_anomaly"), F.col("critical_rate").alias("anomaly_score"), F.lit(0).alias("cluster_label"))


@query("stream_alarm_lines", RES[:-1] + ALARMS + " SELECT line, count(*) AS n FROM lines GROUP BY 1")
def stream_alarm_lines(spark, sf):
    """Files in time order, one part each: alarms with messages from the ledger itself, the batch operator's lines."""
    out = fresh_path(spark, "ledger")
    LG.start_ledger_detection(opened(spark, replay(spark, sf, parts=1)), by_rate, WIDTH, out, fresh_path(spark, "cp"), LONG).awaitTermination()
    return spark.read.text(f"{out}/alarms/*").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_ledger_totals", f"WITH {LOGS}{volume_sql('1 hour', digits=None)} SELECT CAST(sum(log_count) AS BIGINT) AS logs, count(*) AS windows, 0 AS late, "
       "CAST(count(*) FILTER (critical_rate >= 0.5) AS INTEGER) AS anomalies FROM vol")
def stream_ledger_totals(spark, sf):
    """Two files, a stop, a third file: totals after the restart, from the tables."""
    out, cp, path = fresh_path(spark, "ledger"), fresh_path(spark, "cp"), fresh_path(spark, "replay")
    for stage in ([0, 1], [2]):
        for i in stage:
            add_file(spark, sf, path, i)
        LG.start_ledger_detection(opened(spark, path), by_rate, "1 hour", out, cp, LONG).awaitTermination()
    return LG.ledger_totals(spark, out)


@query("stream_ledger_detect", f"WITH RECURSIVE {LOGS}{WINDOWS}{dbscan_sql(WEPS, WNEED)}{SCORED.replace('65', str(len(VOLUME_COLS) + 1))}{GT}, "
       "o AS (SELECT make_timestamp(id) AS timestamp, CAST(label = -1 AS INTEGER) AS is_anomaly, round(raw / max(raw) OVER (), 6) AS anomaly_score, label AS cluster_label FROM rw) "
       "SELECT timestamp, is_anomaly, anomaly_score, cluster_label, log_count, ground_truth FROM o JOIN vol USING (timestamp) JOIN g USING (timestamp)")
def stream_ledger_detect(spark, sf):
    """Stored model and stored core index on the ledger's windows."""
    out = fresh_path(spark, "ledger")
    model = P.fit_detector(logs_of(spark, sf), "1 hour", WEPS, WNEED)
    LG.start_ledger_detection(opened(spark, replay(spark, sf, parts=2)), model, "1 hour", out, fresh_path(spark, "cp"), LONG).awaitTermination()
    return stored(spark, f"{out}/results", ["timestamp", "is_anomaly", "anomaly_score", "cluster_label", "log_count", "ground_truth"])


@query("hourly_refresh_stored", f"{RES}SELECT true AS idle, s.* FROM ({SUMMARY.format(where='')}) s")
def hourly_refresh_stored(spark, sf):
    """Two batches, a refresh, a third batch on some dates, a refresh of these dates only, and one that finds nothing to do."""
    path, summary, rows = fresh_path(spark, "results"), fresh_path(spark, "summary"), settle(results_of(spark, sf))
    day = F.dayofmonth("timestamp")
    sinks.upsert_results(rows.filter(day <= 10).withColumn("anomaly_score", F.lit(9.0)), path, 0)
    sinks.upsert_results(rows.filter(day > 10), path, 1)
    sinks.refresh_summary(spark, path, summary)
    sinks.upsert_results(rows.filter(day <= 10), path, 2)
    sinks.refresh_summary(spark, path, summary)
    idle = sinks.refresh_summary(spark, path, summary) == 0
    return sinks.read_summary(spark, summary).select(F.lit(idle).alias("idle"), "*")


@query("stream_multi_width", f"WITH {LOGS} " + " UNION ALL ".join(
    f"SELECT '{w}' AS width, time_bucket(INTERVAL '{w}', timestamp) AS timestamp, count(level) AS log_count, "
    + ", ".join(f"count(*) FILTER (level = '{lv.upper()}') AS {lv}_count" for lv in ("error", "fatal", "warn", "info", "debug"))
    + " FROM logs GROUP BY 2" for w in MULTI))
def stream_multi_width(spark, sf):
    """Several widths of one stream, from its ledger of 30 second windows."""
    out = fresh_path(spark, "ledger")
    LG.start_ledger(opened(spark, replay(spark, sf)), "30 seconds", out, fresh_path(spark, "cp"), LONG).awaitTermination()
    return LG.ledger_widths(spark, out, list(MULTI))


@query("stream_rolling_stats", _rolling_sql())
def stream_rolling_stats(spark, sf):
    """Interleaved replay: a window that grows changes the trailing statistics behind it; the result is the batch's."""
    out = fresh_path(spark, "ledger")
    handler = LG.rolling_updates(out, ["log_count", "error_rate"], ROLL_SPANS, 30)
    LG.start_ledger(opened(spark, replay(spark, sf)), "30 seconds", out, fresh_path(spark, "cp"), LONG, on_windows=handler).awaitTermination()
    return sinks.read_results(spark, f"{out}/rolling", "last").drop("window_start", "ground_truth")
