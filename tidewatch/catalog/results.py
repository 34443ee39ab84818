"""Queries over result rows, sources/sinks, evaluation and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import LOGS, logs_of, query, volume_sql
from tidewatch.functions.scalar import alarm_text, parse_iso_ts, score_band
from tidewatch.operators import evaluation as E
from tidewatch.operators import latency as L
from tidewatch.operators import results as R
from tidewatch.operators import windows as W
from tidewatch.schemas import LOG_SCHEMA, TRAINING_LOG_SCHEMA
from tidewatch.session import fresh_path
from tidewatch.sources import logs as src
from tidewatch.sources import sinks

WIDTH = "10 minutes"
NOW = "2024-01-31 00:00:00"

# Result rows by rule: score = critical rate, flag = score of at least one half.
RESULTS = f""", res AS (SELECT timestamp, timestamp AS window_start, timestamp + INTERVAL '{WIDTH}' AS window_end,
  CASE WHEN critical_count / log_count >= 0.5 THEN 1 ELSE 0 END AS is_anomaly, critical_count / log_count AS anomaly_score,
  log_count, error_count, critical_count, ground_truth, error_count / log_count AS error_rate, critical_count / log_count AS critical_rate
  FROM (SELECT time_bucket(INTERVAL '{WIDTH}', timestamp) AS timestamp, count(*) AS log_count,
   count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level IN ('ERROR', 'FATAL')) AS critical_count,
   max(is_anomaly) AS ground_truth FROM logs GROUP BY 1))"""
RES = f"WITH {LOGS}{RESULTS} "


def results_of(spark, sf, width=WIDTH):
    rates = R.results_rates(W.buffer_summary(logs_of(spark, sf), width))
    return rates.select(
        "timestamp", F.col("timestamp").alias("window_start"), (F.col("timestamp") + F.expr(f"INTERVAL {width}")).alias("window_end"),
        (F.col("critical_rate") >= 0.5).cast("int").alias("is_anomaly"), F.col("critical_rate").alias("anomaly_score"),
        "log_count", "error_count", "critical_count", "ground_truth", "error_rate", "critical_rate")


@query("results_rates", RES + "SELECT window_start, log_count, round(error_rate, 6) AS error_rate, round(critical_rate, 6) AS critical_rate FROM res")
def results_rates(spark, sf):
    return results_of(spark, sf).select("window_start", "log_count", "error_rate", "critical_rate")


@query("score_band", RES + """SELECT window_start, CASE WHEN anomaly_score < 0.3 THEN 'normal' WHEN anomaly_score <= 0.6 THEN 'borderline'
 WHEN anomaly_score <= 0.8 THEN 'likely' ELSE 'definite' END AS band FROM res""")
def band(spark, sf):
    return results_of(spark, sf).select("window_start", score_band("anomaly_score").alias("band"))


@query("alert_on_score", RES + "SELECT window_start, round(anomaly_score, 6) AS anomaly_score FROM res WHERE anomaly_score >= 0.7")
def alert_on_score(spark, sf):
    return R.alert_on_score(results_of(spark, sf)).select("window_start", "anomaly_score")


@query("alert_on_rate", RES + """SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, round(avg(is_anomaly), 6) AS anomaly_rate
 FROM res GROUP BY 1) WHERE anomaly_rate > 0.1""")
def alert_on_rate(spark, sf):
    return R.alert_on_rate(results_of(spark, sf))


SUMMARY = """SELECT time_bucket(INTERVAL '1 hour', timestamp) AS bucket, count(*) AS total_windows, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count,
 round(avg(anomaly_score), 6) AS avg_anomaly_score, round(max(anomaly_score), 6) AS max_anomaly_score,
 round(avg(error_rate), 6) AS avg_error_rate, round(avg(critical_rate), 6) AS avg_critical_rate FROM res {where} GROUP BY 1"""


@query("anomaly_summary_hourly", RES + SUMMARY.format(where=""))
def anomaly_summary_hourly(spark, sf):
    return R.anomaly_summary_hourly(results_of(spark, sf))


@query("hourly_refresh", RES + SUMMARY.format(where="WHERE timestamp >= TIMESTAMP '2024-01-20 13:00:00' AND timestamp < TIMESTAMP '2024-01-21 12:00:00'"))
def hourly_refresh(spark, sf):
    return R.hourly_refresh(results_of(spark, sf), "2024-01-21 12:25:00")


@query("retention", f"""WITH {LOGS}{RESULTS} SELECT 'results' AS kind, count(*) AS kept FROM res WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
 UNION ALL SELECT 'raw', count(*) FROM logs WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""")
def retention(spark, sf):
    kept = lambda df, kind, keep: R.retention(df, NOW, keep).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("kept"))
    return kept(results_of(spark, sf), "results", "30 days").unionByName(kept(logs_of(spark, sf), "raw", "7 days"))


@query("range_by_flag", RES + "SELECT timestamp, round(anomaly_score, 6) AS anomaly_score FROM res WHERE is_anomaly = 1 ORDER BY timestamp DESC")
def range_by_flag(spark, sf):
    return R.range_by_flag(results_of(spark, sf)).select("timestamp", "anomaly_score")


@query("range_by_start", RES + "SELECT window_start, log_count FROM res WHERE window_start >= TIMESTAMP '2024-01-10' AND window_start < TIMESTAMP '2024-01-12'")
def range_by_start(spark, sf):
    return R.range_by_start(results_of(spark, sf), "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("window_start", "log_count")


@query("logs_by_level", f"WITH {LOGS} SELECT event_id, timestamp, message FROM logs WHERE level = 'FATAL' ORDER BY timestamp DESC")
def logs_by_level(spark, sf):
    return R.logs_by_level(logs_of(spark, sf), "FATAL").select("event_id", "timestamp", "message")


ALARMS = """, heads AS (SELECT window_start, 0 AS line_no, printf('ANOMALY DETECTED | Score: %.3f | Window: %s to %s | Logs: %d | Errors: %d (%.1f%%) | Critical: %d',
  anomaly_score, strftime(window_start, '%Y-%m-%dT%H:%M:%S.%gZ'), strftime(window_end, '%Y-%m-%dT%H:%M:%S.%gZ'), log_count, error_count,
  error_rate * 100.0, critical_count) AS line FROM res WHERE is_anomaly = 1),
 smp AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS window_start, message,
   CAST(row_number() OVER (PARTITION BY time_bucket(INTERVAL '10 minutes', timestamp) ORDER BY timestamp, event_id) AS INTEGER) AS line_no
   FROM logs WHERE level IN ('ERROR', 'FATAL')),
 lines AS (SELECT window_start, line_no, line FROM heads UNION ALL
   SELECT window_start, line_no, '  Sample Error ' || line_no || ': ' || message FROM smp
   WHERE line_no <= 3 AND window_start IN (SELECT window_start FROM heads))"""


@query("alarm_lines", RES[:-1] + ALARMS + " SELECT window_start, line_no, line FROM lines")
def alarm_lines(spark, sf):
    return R.alarm_lines(results_of(spark, sf), logs_of(spark, sf), WIDTH)


@query("snk_alarm_lines", RES[:-1] + ALARMS + " SELECT line, count(*) AS n FROM lines GROUP BY 1")
def snk_alarm_lines(spark, sf):
    path = fresh_path(spark, "alarms")
    sinks.write_alarms(R.alarm_lines(results_of(spark, sf), logs_of(spark, sf), WIDTH), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("pattern_rules", f"""WITH {LOGS}{volume_sql('1 hour', digits=None)}, base AS (SELECT hour(timestamp) AS h, quantile_cont(log_count, 0.5) AS normal_count,
  quantile_cont(critical_count, 0.5) AS normal_critical FROM vol GROUP BY 1),
 svc AS (SELECT time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, count(DISTINCT service) AS s FROM logs WHERE level IN ('ERROR', 'FATAL') GROUP BY 1)
 SELECT timestamp, log_count, critical_count, coalesce(s, 0) AS critical_services, normal_count,
  CAST(critical_count > 3.0 * normal_critical AND critical_rate > 0.5 AS INTEGER) AS error_spike,
  CAST(log_count >= 10.0 * normal_count AS INTEGER) AS log_flood, CAST(log_count <= 0.1 * normal_count AS INTEGER) AS silent_failure,
  CAST(coalesce(s, 0) >= 3 AS INTEGER) AS cascade, CAST(warn_to_info_ratio > 1 AS INTEGER) AS warning_storm
 FROM vol JOIN base ON hour(timestamp) = h LEFT JOIN svc USING (timestamp)""")
def pattern_rules(spark, sf):
    logs = logs_of(spark, sf)
    return R.pattern_rules(W.volume_features(logs, "1 hour"), logs, "1 hour")


# Every log is one write of its hour's result row: many versions per key.
WRITES = f"""WITH {LOGS}, wr AS (SELECT time_bucket(INTERVAL '1 hour', l.timestamp) AS timestamp, e.value AS anomaly_score, l.is_anomaly AS ground_truth,
  CASE WHEN e.value >= 60 THEN 1 ELSE 0 END AS is_anomaly, l.event_id AS arrival FROM logs l JOIN events e USING (event_id)),
 latest AS (SELECT timestamp, timestamp AS window_start, arg_max(anomaly_score, arrival) AS anomaly_score, arg_max(is_anomaly, arrival) AS is_anomaly,
  arg_min(ground_truth, arrival) AS ground_truth, max(arrival) AS arrival FROM wr GROUP BY 1)"""


def _writes(spark, sf):
    ev = spark.read.schema(src.EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    logs = src.events_as_logs(ev, ["value"]).select("event_id", "timestamp", "is_anomaly", "value")
    rows = W.tumbling(logs, "1 hour")
    return rows.select(
        F.col("window_start").alias("timestamp"), "window_start", F.col("value").alias("anomaly_score"),
        (F.col("value") >= 60).cast("int").alias("is_anomaly"), F.col("is_anomaly").alias("ground_truth"), F.col("event_id").alias("arrival"))


@query("results_latest", WRITES + " SELECT timestamp, window_start, anomaly_score, is_anomaly, ground_truth, arrival FROM latest")
def results_latest(spark, sf):
    return R.results_latest(_writes(spark, sf))


@query("snk_results_upsert", WRITES + " SELECT timestamp, window_start, anomaly_score, is_anomaly, ground_truth FROM latest")
def snk_results_upsert(spark, sf):
    """Two batches by arrival, the second one written twice (a replay)."""
    path, writes = fresh_path(spark, "results"), _writes(spark, sf)
    half = writes.agg(F.percentile_approx("arrival", 0.5)).scalar()
    sinks.upsert_results(writes.filter(F.col("arrival") <= half), path, 0, "arrival")
    for _ in range(2):
        sinks.upsert_results(writes.filter(F.col("arrival") > half), path, 1, "arrival")
    return sinks.read_results(spark, path)


# ---- sources and sinks -----------------------------------------------------------------------

LOG_COLS = ["timestamp", "level", "service", "message", "is_anomaly"]


def _json(logs):
    return logs.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).select(
        "event_id", F.to_json(F.struct(*LOG_COLS)).alias("value"))


@query("src_json_logs", f"WITH {LOGS} SELECT event_id, {', '.join(LOG_COLS)} FROM logs WHERE event_id % 17 <> 0")
def src_json_logs(spark, sf):
    """Encode, damage some records by rule, decode, quarantine."""
    coded = _json(logs_of(spark, sf)).withColumn(
        "value", F.when(F.col("event_id") % 17 == 0, F.substring("value", 1, 30)).otherwise(F.col("value")))
    good, _ = src.split_corrupt(src.decode_json_logs(coded))
    return good


@query("continue_on_bad_window", f"""WITH {LOGS} SELECT level, count(*) FILTER (event_id % 17 <> 0) AS kept, 
  (SELECT count(*) FROM logs WHERE event_id % 17 = 0) AS quarantined FROM logs GROUP BY 1""")
def continue_on_bad_window(spark, sf):
    coded = _json(logs_of(spark, sf)).withColumn(
        "value", F.when(F.col("event_id") % 17 == 0, F.regexp_replace("value", "2024-", "not-a-time-")).otherwise(F.col("value")))
    good, bad = src.split_corrupt(src.decode_json_logs(coded))
    return good.groupBy("level").agg(F.count(F.lit(1)).alias("kept")).withColumn("quarantined", bad.agg(F.count(F.lit(1))).scalar())


@query("src_parquet_logs", f"WITH {LOGS} SELECT event_id, {', '.join(LOG_COLS)}, anomaly_type FROM logs")
def src_parquet_logs(spark, sf):
    """Training logs with text timestamps, stored and read back."""
    path = fresh_path(spark, "logs")
    logs_of(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.parquet(path)
    return src.read_parquet_logs(spark, path)


@query("src_csv_logs", f"WITH {LOGS} SELECT {', '.join(LOG_COLS)}, anomaly_type FROM logs")
def src_csv_logs(spark, sf):
    path = fresh_path(spark, "csv")
    text_ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    sinks.write_csv(logs_of(spark, sf).withColumn("timestamp", text_ts).select(*TRAINING_LOG_SCHEMA.fieldNames()), path)
    return src.read_csv_logs(spark, path)


BAD_SQL = f"""WITH {LOGS}, t AS (SELECT level, event_id % 17 = 0 AS bad, event_id % 19 = 0 AS broken FROM logs)
 SELECT 'good' AS kind, level, count(*) AS n, count(*) FILTER (broken) AS broken FROM t WHERE NOT bad GROUP BY 2
 UNION ALL SELECT 'bad', NULL, count(*), NULL FROM t WHERE bad"""


def _damaged(logs):
    """Some unreadable times, some messages over two lines."""
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return logs.withColumns({
        "timestamp": F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("not "), text)).otherwise(text),
        "message": F.when(F.col("event_id") % 19 == 0, F.concat("message", F.lit("\n, second line"))).otherwise(F.col("message"))})


def _accounted(good, bad):
    kept = good.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("message").contains("\n")).alias("broken"))
    lost = bad.select("file", "record").distinct().agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.lit("good").alias("kind"), "level", "n", "broken").unionByName(lost.select(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("level"), "n", F.lit(None).cast("long").alias("broken")))


@query("src_csv_quarantine", BAD_SQL)
def src_csv_quarantine(spark, sf):
    """Good and bad records together are the input; every bad one has a place of its own."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(_damaged(logs_of(spark, sf)).select(*TRAINING_LOG_SCHEMA.fieldNames()).repartition(3), path)
    return _accounted(*src.split_bad_csv(spark, path))


@query("src_parquet_quarantine", BAD_SQL)
def src_parquet_quarantine(spark, sf):
    path = fresh_path(spark, "logs")
    _damaged(logs_of(spark, sf)).repartition(3).write.parquet(path)
    return _accounted(*src.split_bad_parquet(spark, path))


@query("parse_iso_ts", """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS parsed FROM events""")
def parse_ts(spark, sf):
    text = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    broken = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return logs_of(spark, sf).select("event_id", parse_iso_ts(broken).alias("parsed"))


@query("snk_parquet_features", f"WITH {LOGS}{volume_sql('30 seconds')} SELECT * FROM vol")
def snk_parquet_features(spark, sf):
    path = fresh_path(spark, "features")
    sinks.write_features(W.volume_features(logs_of(spark, sf), "30 seconds"), path)
    return spark.read.parquet(path)


@query("snk_csv_results", RES + "SELECT timestamp, is_anomaly, round(anomaly_score, 6) AS anomaly_score FROM res")
def snk_csv_results(spark, sf):
    path = fresh_path(spark, "csv-results")
    sinks.write_csv(results_of(spark, sf).select("timestamp", "is_anomaly", "anomaly_score"), path)
    return spark.read.schema("timestamp timestamp, is_anomaly int, anomaly_score double").option("header", True).csv(path)


@query("snk_kafka_results", RES + """SELECT strftime(window_start, '%Y-%m-%dT%H:%M:%S.%gZ') AS window_start, is_anomaly, log_count,
 round(anomaly_score, 6) AS anomaly_score, ground_truth FROM res""")
def snk_kafka_results(spark, sf):
    """The broker payload, decoded again (the connector itself is absent here)."""
    coded = sinks.encode_results(results_of(spark, sf))
    back = F.from_json("value", "window_start string, is_anomaly int, log_count long, anomaly_score double, ground_truth int")
    return coded.select(back.alias("r")).select("r.*")


@query("results_from_messages", RES + "SELECT window_start, is_anomaly, log_count, round(anomaly_score, 6) AS anomaly_score, ground_truth, error_rate, critical_rate FROM res")
def results_from_messages(spark, sf):
    """Results that arrive as messages: decoded, rates added, upserted and read back."""
    path = fresh_path(spark, "from-messages")
    rows = sinks.decode_results(sinks.encode_results(results_of(spark, sf).drop("error_rate", "critical_rate")))
    sinks.upsert_results(rows, path, 0)
    return sinks.read_results(spark, path).select("window_start", "is_anomaly", "log_count", "anomaly_score", "ground_truth", "error_rate", "critical_rate")


@query("json_encode", f"WITH {LOGS} SELECT event_id, level, message, is_anomaly FROM logs")
def json_codec(spark, sf):
    return _json(logs_of(spark, sf)).select("event_id", F.from_json("value", LOG_SCHEMA).alias("r")).select("event_id", "r.level", "r.message", "r.is_anomaly")


# ---- evaluation ------------------------------------------------------------------------------

CM = """cm AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
 count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels)"""
PRF = "round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score"


def _labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@query("confusion_matrix", f"WITH {CM} SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(_labels(spark, sf), "quality", "toxic")


@query("precision_recall_f1", f"WITH {CM} SELECT {PRF} FROM cm")
def precision_recall_f1(spark, sf):
    return E.precision_recall_f1(_labels(spark, sf), "quality", "toxic")


@query("classification_report", f"""WITH {CM}, k AS (SELECT '0' AS class, tn AS tp, fn AS fp, fp AS fn FROM cm UNION ALL SELECT '1', tp, fp, fn FROM cm),
 s AS (SELECT class, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f, tp + fn AS support FROM k),
 a AS (SELECT class, p, r, f, support FROM s UNION ALL
  SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cm UNION ALL
  SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM s UNION ALL
  SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM s)
 SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM a""")
def classification_report(spark, sf):
    return E.classification_report(_labels(spark, sf), "quality", "toxic")


@query("model_comparison", """WITH m AS (SELECT 'toxic' AS model, quality AS t, toxic AS p FROM labels UNION ALL SELECT 'clean', quality, 1 - toxic FROM labels),
 c AS (SELECT model, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn,
  count(*) FILTER (t = 1 AND p = 1) AS tp FROM m GROUP BY 1),
 s AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS rc, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c)
 SELECT model, tn, fp, fn, tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1_score, tp + fp AS predicted,
  CASE WHEN f1 = (SELECT max(f1) FROM s) THEN 1 ELSE 0 END AS is_best FROM s""")
def model_comparison(spark, sf):
    flags = _labels(spark, sf).withColumn("clean", 1 - F.col("toxic"))
    return E.model_comparison(flags, "quality", {"toxic": "toxic", "clean": "clean"})


@query("evaluate_results", RES + """, c AS (SELECT count(*) FILTER (ground_truth = 0 AND is_anomaly = 0) AS tn, count(*) FILTER (ground_truth = 0 AND is_anomaly = 1) AS fp,
 count(*) FILTER (ground_truth = 1 AND is_anomaly = 0) AS fn, count(*) FILTER (ground_truth = 1 AND is_anomaly = 1) AS tp FROM res)
 SELECT tn, fp, fn, tp, """ + PRF + " FROM c")
def evaluate_results(spark, sf):
    return E.evaluate_results(results_of(spark, sf))


@query("contamination_estimate", RES + "SELECT round(CASE WHEN avg(ground_truth) > 0 AND avg(ground_truth) <= 0.5 THEN avg(ground_truth) ELSE 0.01 END, 6) AS contamination FROM res")
def contamination_estimate(spark, sf):
    return E.contamination_estimate(results_of(spark, sf), "ground_truth")


# ---- latency ---------------------------------------------------------------------------------

# Detection latency of a log = time to the end of its 30 s window; alarm delay = its value, when flagged.
PROBE = """WITH m AS (SELECT event_id, (epoch_us(time_bucket(INTERVAL '30 seconds', ts)) + 30000000 - epoch_us(ts)) / 1000.0 AS detection_ms,
 CASE WHEN event_type = 'error' AND value >= 150 THEN value END AS alarm_ms FROM events),
 p AS (SELECT *, detection_ms + coalesce(alarm_ms, 0) AS total_ms, alarm_ms IS NOT NULL AS alarm_logged FROM m)"""
STAT = """SELECT '{c}' AS metric, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99,
 min({c}) AS min, max({c}) AS max FROM p"""
MEASURES = ["detection_ms", "alarm_ms", "total_ms"]


def _probes(spark, sf):
    ev = spark.read.schema(src.EVENT_SCHEMA).parquet(f"{sf}/events.parquet").withColumn("timestamp", F.col("ts").cast("timestamp"))
    rows = W.tumbling(ev, "30 seconds").select(
        "event_id", ((F.unix_micros("window_end") - F.unix_micros("timestamp")) / 1000.0).alias("detection_ms"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 150), F.col("value")).alias("alarm_ms"))
    return rows.withColumns({"total_ms": F.col("detection_ms") + F.coalesce("alarm_ms", F.lit(0.0)), "alarm_logged": F.col("alarm_ms").isNotNull()})


@query("latency_percentiles", PROBE + ", u AS (" + " UNION ALL ".join(STAT.format(c=c) for c in MEASURES) + ") SELECT metric, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "median", "p95", "p99", "min", "max")) + " FROM u")
def latency_percentiles(spark, sf):
    return L.latency_percentiles(_probes(spark, sf), MEASURES)


@query("latency_sla_check", PROBE + ", u AS (" + STAT.format(c="total_ms") + """) SELECT metric, round(mean / 1000, 6) AS avg_seconds, round(p95 / 1000, 6) AS p95_seconds,
 round(p99 / 1000, 6) AS p99_seconds, CAST(mean / 1000 < 33 AS INTEGER) AS avg_ok, CAST(p95 / 1000 < 33 AS INTEGER) AS p95_ok, CAST(p99 / 1000 < 33 AS INTEGER) AS p99_ok,
 round(33 - mean / 1000, 6) AS avg_margin, round(33 - p95 / 1000, 6) AS p95_margin, round(33 - p99 / 1000, 6) AS p99_margin,
 CAST(mean / 1000 < 33 AND p95 / 1000 < 33 AND p99 / 1000 < 33 AS INTEGER) AS all_ok FROM u""")
def latency_sla_check(spark, sf):
    return L.latency_sla_check(L.latency_percentiles(_probes(spark, sf), ["total_ms"]), "total_ms")


@query("alarm_rate", PROBE + " SELECT count(*) FILTER (alarm_logged) AS alarms_logged, count(*) AS total, round(avg(CAST(alarm_logged AS INTEGER)) * 100, 6) AS alarm_rate_pct FROM p")
def alarm_rate(spark, sf):
    return L.alarm_rate(_probes(spark, sf))


@query("alarm_text", RES[:-1] + ALARMS + " SELECT window_start, line FROM heads")
def alarm_heads(spark, sf):
    return results_of(spark, sf).filter("is_anomaly = 1").select("window_start", alarm_text().alias("line"))


@query("json_decode", f"WITH {LOGS} SELECT event_id, timestamp, level, service, message, is_anomaly FROM logs")
def json_decode(spark, sf):
    good, _ = src.split_corrupt(src.decode_json_logs(_json(logs_of(spark, sf))))
    return good
