"""Queries over log records: windows, profiles, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import LOGS, TEMPLATES, logs_of, query, volume_sql
from tidewatch.functions.scalar import calendar_cols, iso_format, nan_inf_to_zero, round_pct
from tidewatch.functions.text import message_prefix, normalize_message_v2
from tidewatch.operators import profiles as P
from tidewatch.operators import templates as T
from tidewatch.operators import windows as W
from tidewatch.plans.incidents import inject_incidents
from tidewatch.schemas import COUNT_COLS, RATE_COLS, VOLUME_COLS

H, S30 = "1 hour", "30 seconds"
HB = "time_bucket(INTERVAL '1 hour', timestamp)"


@query("level_indicators", f"""WITH {LOGS} SELECT event_id, CAST(level = 'ERROR' AS INTEGER) AS is_error,
 CAST(level = 'FATAL' AS INTEGER) AS is_fatal, CAST(level = 'WARN' AS INTEGER) AS is_warn,
 CAST(level = 'INFO' AS INTEGER) AS is_info, CAST(level = 'DEBUG' AS INTEGER) AS is_debug FROM logs""")
def level_indicators(spark, sf):
    return W.level_indicators(logs_of(spark, sf)).select("event_id", "is_error", "is_fatal", "is_warn", "is_info", "is_debug")


@query("filter_critical", f"WITH {LOGS} SELECT event_id, timestamp, level, message FROM logs WHERE level IN ('ERROR', 'FATAL')")
def filter_critical(spark, sf):
    return P.filter_critical(logs_of(spark, sf)).select("event_id", "timestamp", "level", "message")


@query("filter_label", f"WITH {LOGS} SELECT event_id, level, service FROM logs WHERE is_anomaly = 1")
def filter_label(spark, sf):
    return P.filter_label(logs_of(spark, sf), 1).select("event_id", "level", "service")


@query("filter_expected_errors", f"WITH {LOGS} SELECT event_id, level FROM logs WHERE level IN ('ERROR', 'FATAL') AND is_anomaly = 0")
def filter_expected_errors(spark, sf):
    return P.filter_expected_errors(logs_of(spark, sf)).select("event_id", "level")


@query("tumbling", f"""WITH {LOGS} SELECT event_id, time_bucket(INTERVAL '30 seconds', timestamp) AS window_start,
 time_bucket(INTERVAL '30 seconds', timestamp) + INTERVAL '30 seconds' AS window_end FROM logs""")
def tumbling(spark, sf):
    return W.tumbling(logs_of(spark, sf), S30).select("event_id", "window_start", "window_end")


@query("window_counts", f"WITH {LOGS}{volume_sql('30 seconds')} SELECT * FROM vol_n")
def window_counts(spark, sf):
    return W.window_counts(logs_of(spark, sf), S30)


@query("window_rates", f"WITH {LOGS}{volume_sql('30 seconds')} SELECT timestamp, {', '.join(RATE_COLS)} FROM vol")
def window_rates(spark, sf):
    return W.window_rates(W.window_counts(logs_of(spark, sf), S30)).select("timestamp", *RATE_COLS)


@query("volume_features", f"WITH {LOGS}{volume_sql('1 hour')} SELECT * FROM vol")
def volume_features(spark, sf):
    return W.volume_features(logs_of(spark, sf), H)


@query("window_labels", f"WITH {LOGS} SELECT {HB} AS timestamp, max(is_anomaly) AS is_anomaly FROM logs GROUP BY 1")
def window_labels(spark, sf):
    return W.window_labels(logs_of(spark, sf), H)


BUFFER_SQL = """SELECT time_bucket(INTERVAL '{w}', timestamp) AS timestamp, count(*) AS log_count,
 count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level IN ('ERROR', 'FATAL')) AS critical_count,
 max(is_anomaly) AS ground_truth FROM logs GROUP BY 1"""


@query("buffer_summary", f"WITH {LOGS} {BUFFER_SQL.format(w='30 seconds')}")
def buffer_summary(spark, sf):
    return W.buffer_summary(logs_of(spark, sf), S30)


GRID = """, grid AS (SELECT unnest(generate_series(lo, hi, INTERVAL '{w}')) AS timestamp
  FROM (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM vol_n))"""


@query("gap_fill", f"WITH {LOGS}{volume_sql('30 seconds')}{GRID.format(w='30 seconds')} SELECT timestamp, "
       + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNT_COLS) + " FROM grid LEFT JOIN vol_n USING (timestamp)")
def gap_fill(spark, sf):
    return W.gap_fill(W.window_counts(logs_of(spark, sf), S30), S30)


def _any_width_sql(width: str) -> str:
    """All bins of a width that need not divide a day, from the midnight before the first log on."""
    vol = volume_sql(width).replace("timestamp) AS timestamp", "timestamp, (SELECT date_trunc('day', min(timestamp)) FROM logs)) AS timestamp", 1)
    return (f"WITH {LOGS}{vol}{GRID.format(w=width)} SELECT timestamp, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*COUNT_COLS, *RATE_COLS))
            + " FROM grid LEFT JOIN vol USING (timestamp)")


def _any_width(width: str):
    def run(spark, sf):
        logs = logs_of(spark, sf)
        return W.volume_features(logs, width, True, W.first_midnight(logs, width))

    return run


for _width, _tag in (("7 minutes", "7m"), ("45 seconds", "45s"), ("2 days", "2d")):
    query(f"gap_fill_{_tag}", _any_width_sql(_width))(_any_width(_width))


MULTI = {"1 minute": "1 minute", "5 minutes": "5 minutes", "1 hour": "1 hour"}


@query("multi_width", f"WITH {LOGS} " + " UNION ALL ".join(
    f"SELECT '{w}' AS width, time_bucket(INTERVAL '{w}', timestamp) AS timestamp, count(level) AS log_count, "
    + ", ".join(f"count(*) FILTER (level = '{lv.upper()}') AS {lv}_count" for lv in ("error", "fatal", "warn", "info", "debug"))
    + " FROM logs GROUP BY 2" for w in MULTI))
def multi_width(spark, sf):
    return W.multi_width(logs_of(spark, sf), "30 seconds", list(MULTI))


ROLL_SPANS = {"5min": 300, "15min": 900, "1h": 3600}


def _rolling_sql() -> str:
    cols = []
    for suffix, sec in ROLL_SPANS.items():
        over = f"OVER (ORDER BY timestamp RANGE BETWEEN INTERVAL {sec - 30} SECONDS PRECEDING AND CURRENT ROW)"
        for c in ("log_count", "error_rate"):
            cols += [f"round(avg({c}) {over}, 6) AS {c}_mean_{suffix}",
                     f"max({c}) {over} AS {c}_max_{suffix}" if c == "log_count" else f"round(max({c}) {over}, 6) AS {c}_max_{suffix}",
                     f"min({c}) {over} AS {c}_min_{suffix}" if c == "log_count" else f"round(min({c}) {over}, 6) AS {c}_min_{suffix}",
                     f"round(coalesce(stddev_samp({c}) {over}, 0), 6) AS {c}_std_{suffix}",
                     f"round(quantile_cont({c}, 0.95) {over}, 6) AS {c}_p95_{suffix}"]
    return f"WITH {LOGS}{volume_sql('30 seconds', digits=None)} SELECT timestamp, {', '.join(cols)} FROM vol"


@query("rolling_stats", _rolling_sql())
def rolling_stats(spark, sf):
    return W.rolling_stats(W.volume_features(logs_of(spark, sf), S30), ["log_count", "error_rate"], ROLL_SPANS)


@query("sample_errors", f"""WITH {LOGS} SELECT window_start, CAST(sample_no AS INTEGER) AS sample_no, event_id, message FROM (
 SELECT *, {HB} AS window_start, row_number() OVER (PARTITION BY {HB} ORDER BY timestamp, event_id) AS sample_no
 FROM logs WHERE level IN ('ERROR', 'FATAL')) WHERE sample_no <= 3""")
def sample_errors(spark, sf):
    return W.sample_errors(logs_of(spark, sf), H).select("window_start", "sample_no", "event_id", "message")


@query("calendar_cols", f"""WITH {LOGS} SELECT event_id, CAST(hour(timestamp) AS INTEGER) AS hour, dayname(timestamp) AS day_of_week,
 CAST(timestamp AS DATE) AS date, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, substring(message, 1, 50) AS prefix FROM logs""")
def calendar(spark, sf):
    return calendar_cols(logs_of(spark, sf)).select(
        "event_id", "hour", "day_of_week", "date", iso_format("timestamp").alias("iso"), message_prefix("message").alias("prefix"))


@query("level_distribution", f"""WITH {LOGS} SELECT level, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM logs), 6) AS percentage
 FROM logs GROUP BY level""")
def level_distribution(spark, sf):
    return P.distribution(logs_of(spark, sf), "level")


@query("service_distribution", f"""WITH {LOGS} SELECT service, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM logs), 6) AS percentage
 FROM logs GROUP BY service""")
def service_distribution(spark, sf):
    return P.distribution(logs_of(spark, sf), "service")


@query("level_by_label_crosstab", f"""WITH {LOGS} SELECT coalesce(level, 'All') AS level, count(*) FILTER (is_anomaly = 0) AS normal,
 count(*) FILTER (is_anomaly = 1) AS anomaly, count(is_anomaly) AS total FROM logs GROUP BY ROLLUP (level)""")
def level_by_label_crosstab(spark, sf):
    return P.level_by_label_crosstab(logs_of(spark, sf))


@query("anomaly_type_distribution", f"WITH {LOGS} SELECT anomaly_type, count(*) AS count FROM logs WHERE is_anomaly = 1 GROUP BY 1")
def anomaly_type_distribution(spark, sf):
    return P.anomaly_type_distribution(logs_of(spark, sf))


@query("daily_stats", f"""WITH {LOGS} SELECT CAST(timestamp AS DATE) AS date, count(*) AS total_logs, CAST(sum(is_anomaly) AS BIGINT) AS anomalies,
 round_even(sum(is_anomaly) / count(*) * 100, 2) AS anomaly_pct FROM logs GROUP BY 1""")
def daily_stats(spark, sf):
    return P.daily_stats(logs_of(spark, sf))


@query("class_balance", f"""WITH {LOGS} SELECT count(*) AS total, count(*) FILTER (is_anomaly = 0) AS normal,
 count(*) FILTER (is_anomaly = 1) AS anomalous, round(avg(is_anomaly) * 100, 6) AS anomaly_rate_pct FROM logs""")
def class_balance(spark, sf):
    return P.class_balance(logs_of(spark, sf))


@query("hourly_profile", f"WITH {LOGS} SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS count FROM logs GROUP BY 1")
def hourly_profile(spark, sf):
    return P.hourly_profile(logs_of(spark, sf))


@query("weekday_profile", f"""WITH {LOGS} SELECT CAST(d.day_no AS INTEGER) AS day_no, d.day_of_week, c.count FROM
 (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) d(day_no, day_of_week)
 LEFT JOIN (SELECT dayname(timestamp) AS n, count(*) AS count FROM logs GROUP BY 1) c ON c.n = d.day_of_week""")
def weekday_profile(spark, sf):
    return P.weekday_profile(logs_of(spark, sf))


@query("hourly_volume", f"""WITH {LOGS}, h AS (SELECT {HB} AS timestamp, count(*) AS n FROM logs GROUP BY 1),
 g AS (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM h)
 SELECT timestamp, coalesce(n, 0) AS count FROM g LEFT JOIN h USING (timestamp)""")
def hourly_volume(spark, sf):
    return P.hourly_volume(logs_of(spark, sf))


@query("peak_hours", f"WITH {LOGS} SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def peak_hours(spark, sf):
    return P.peak_hours(logs_of(spark, sf))


@query("missing_values", f"""WITH {LOGS}, m AS (SELECT count(*) AS n, count(*) FILTER (anomaly_type IS NULL) AS anomaly_type,
 count(*) FILTER (message IS NULL) AS message, count(*) FILTER (level IS NULL) AS level FROM logs)
 SELECT column_name, missing_count, round(missing_count * 100.0 / n, 6) AS percentage FROM (
  SELECT n, 'anomaly_type' AS column_name, anomaly_type AS missing_count FROM m UNION ALL
  SELECT n, 'message', message FROM m UNION ALL SELECT n, 'level', level FROM m) WHERE missing_count > 0""")
def missing_values(spark, sf):
    return P.missing_values(logs_of(spark, sf))


def _with_holes(features):
    """Features as a later stage may meet them: nulls, NaN and infinities by rule."""
    return features.withColumns({
        "gap": F.when(F.col("error_count") > 0, F.col("error_rate")),
        "bad": F.try_divide(F.col("warn_count").cast("double"), F.col("info_count")),
        "inf": F.when(F.col("fatal_count") > 2, F.lit(float("inf"))).otherwise(F.col("fatal_rate")),
    })


HOLES = f"""WITH {LOGS}{volume_sql('1 hour', digits=None)}, f AS (SELECT timestamp, CASE WHEN error_count > 0 THEN error_rate END AS gap,
 CASE WHEN info_count <> 0 THEN warn_count / info_count END AS bad, fatal_count > 2 AS is_inf, fatal_rate FROM vol)"""


@query("feature_quality", HOLES + """ SELECT count(*) FILTER (gap IS NULL) + count(*) FILTER (bad IS NULL) AS missing_cells,
 count(*) FILTER (is_inf) AS infinite_cells FROM f""")
def feature_quality(spark, sf):
    return P.feature_quality(_with_holes(W.volume_features(logs_of(spark, sf), H)), ["gap", "bad", "inf"])


@query("nan_inf_to_zero", HOLES + """ SELECT timestamp, round(coalesce(gap, 0), 6) AS gap, round(coalesce(bad, 0), 6) AS bad,
 round(CASE WHEN is_inf THEN 0 ELSE fatal_rate END, 6) AS inf FROM f""")
def nan_inf(spark, sf):
    return nan_inf_to_zero(_with_holes(W.volume_features(logs_of(spark, sf), H)).select("timestamp", "gap", "bad", "inf"))


@query("select_feature_cols", f"WITH {LOGS}{volume_sql('1 hour')} SELECT {', '.join(VOLUME_COLS)} FROM vol")
def select_feature_cols(spark, sf):
    return W.volume_features(logs_of(spark, sf), H).select(*VOLUME_COLS)


@query("dataset_summary", f"""WITH {LOGS} SELECT count(*) AS total_logs, min(timestamp) AS first_log, max(timestamp) AS last_log,
 count(DISTINCT service) AS n_services, string_agg(DISTINCT level, ', ' ORDER BY level) AS levels,
 count(*) FILTER (anomaly_type IS NULL) AS missing_cells FROM logs""")
def dataset_summary(spark, sf):
    return P.dataset_summary(logs_of(spark, sf))


@query("score_describe", """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
 max(value) AS max, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
 round(quantile_cont(value, 0.75), 6) AS p75 FROM events""")
def score_describe(spark, sf):
    return P.score_describe(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query("sort_by_time", f"WITH {LOGS} SELECT event_id, timestamp, level FROM logs ORDER BY timestamp, event_id")
def sort_by_time(spark, sf):
    return P.sort_by_time(logs_of(spark, sf).select("event_id", "timestamp", "level"))


@query("head_n", f"WITH {LOGS} SELECT event_id, timestamp, level FROM logs WHERE is_anomaly = 1 ORDER BY timestamp, event_id LIMIT 10")
def head_n(spark, sf):
    return P.head_n(P.filter_label(logs_of(spark, sf), 1), ["timestamp", "event_id"], 10).select("event_id", "timestamp", "level")


@query("sample_rows", f"WITH {LOGS} SELECT event_id, level FROM logs ORDER BY md5('42-' || CAST(event_id AS VARCHAR)), event_id LIMIT 100")
def sample_rows(spark, sf):
    return P.sample_rows(logs_of(spark, sf), 100, "event_id").select("event_id", "level")


@query("union_logs", f"""WITH {LOGS} SELECT is_anomaly, count(*) AS n FROM (
 SELECT is_anomaly FROM logs WHERE is_anomaly = 0 UNION ALL SELECT is_anomaly FROM logs WHERE is_anomaly = 1) GROUP BY 1""")
def union_logs(spark, sf):
    logs = logs_of(spark, sf)
    return W.union_logs(P.filter_label(logs, 0).drop("anomaly_type"), P.filter_label(logs, 1)).groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"))


TEXT_MEANS = f", cnt AS (SELECT template, count(*) AS c FROM tlogs GROUP BY 1), txt AS (SELECT {HB} AS timestamp, avg(1.0 / c) AS message_rarity FROM tlogs JOIN cnt USING (template) GROUP BY 1)"


def _rarity(logs):
    return T.template_rarity(T.template_counts(logs))


@query("join_volume_text", f"WITH {LOGS}{TEMPLATES}{volume_sql('1 hour')}{TEXT_MEANS} SELECT timestamp, log_count, error_rate, round(message_rarity, 6) AS message_rarity FROM vol LEFT JOIN txt USING (timestamp)")
def join_volume_text(spark, sf):
    logs = logs_of(spark, sf)
    text = W.group_by_window(T.rarity_lookup(logs, _rarity(logs)), [F.avg("message_rarity").alias("message_rarity")], H)
    return W.join_volume_text(W.volume_features(logs, H).select("timestamp", "log_count", "error_rate"), text)


@query("join_feature_sets", f"""WITH {LOGS}{volume_sql('1 hour')} SELECT timestamp, a.log_count, b.log_count AS log_count_text, b.error_rate
 FROM vol a JOIN (SELECT timestamp, log_count, error_rate FROM vol WHERE error_count > 1) b USING (timestamp)""")
def join_feature_sets(spark, sf):
    vol = W.volume_features(logs_of(spark, sf), H)
    return W.join_feature_sets(vol.select("timestamp", "log_count"), vol.filter("error_count > 1").select("timestamp", "log_count", "error_rate"))


@query("join_window_labels", f"""WITH {LOGS}{volume_sql('1 hour')}, lab AS (SELECT {HB} AS timestamp, max(is_anomaly) AS is_anomaly FROM logs GROUP BY 1)
 SELECT timestamp, log_count, critical_rate, coalesce(is_anomaly, 0) AS is_anomaly FROM vol JOIN lab USING (timestamp)""")
def join_window_labels(spark, sf):
    logs = logs_of(spark, sf)
    return W.join_window_labels(W.volume_features(logs, H).select("timestamp", "log_count", "critical_rate"), W.window_labels(logs, H))


# ---- templates -------------------------------------------------------------------------------

@query("normalize_message", f"WITH {LOGS}{TEMPLATES} SELECT event_id, template FROM tlogs")
def normalize_message(spark, sf):
    return T.with_template(logs_of(spark, sf)).select("event_id", "template")


V2 = r"""lower(message)"""
for _p, _r in ((r"(user_|session_|txn_|ord_|item_|cache_)\d+", r"\1<ID>"), (r"\d+ms", "<DURATION>ms"), (r"\d+s", "<DURATION>s"),
               (r"\d+\.\d+\.\d+\.\d+", "<IP>"), (r"/[\w/]+", "<PATH>"), (r"\d+", "<NUM>"), (r"^\s+|\s+$", "")):
    V2 = f"regexp_replace({V2}, '{_p}', '{_r}', 'g')"


@query("normalize_message_v2", f"WITH {LOGS} SELECT event_id, {V2} AS template FROM logs")
def normalize_v2(spark, sf):
    return logs_of(spark, sf).select("event_id", normalize_message_v2("message").alias("template"))


@query("template_counts", f"WITH {LOGS}{TEMPLATES} SELECT template, count(*) AS count FROM tlogs GROUP BY 1")
def template_counts(spark, sf):
    return T.template_counts(logs_of(spark, sf))


@query("template_rarity", f"WITH {LOGS}{TEMPLATES} SELECT template, round(1.0 / count(*), 6) AS rarity FROM tlogs GROUP BY 1")
def template_rarity(spark, sf):
    return _rarity(logs_of(spark, sf))


@query("top_templates", f"WITH {LOGS}{TEMPLATES} SELECT template, count(*) AS count FROM tlogs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_templates(spark, sf):
    return T.top_templates(T.template_counts(logs_of(spark, sf)))


# Rarity trained on the first half of the month, looked up by all logs.
TRAINED = """, tr AS (SELECT template, 1.0 / count(*) AS rarity FROM tlogs WHERE timestamp < TIMESTAMP '2024-01-16' GROUP BY 1),
 sc AS (SELECT event_id, timestamp, template, coalesce(rarity, 1.0) AS message_rarity FROM tlogs LEFT JOIN tr USING (template))"""


def _looked_up(spark, sf):
    logs = logs_of(spark, sf)
    return T.rarity_lookup(logs, _rarity(logs.filter(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"))))


@query("rarity_lookup", f"WITH {LOGS}{TEMPLATES}{TRAINED} SELECT event_id, template, round(message_rarity, 6) AS message_rarity FROM sc")
def rarity_lookup(spark, sf):
    return _looked_up(spark, sf).select("event_id", "template", "message_rarity")


@query("count_rare", f"WITH {LOGS}{TEMPLATES}{TRAINED} SELECT count(*) FILTER (message_rarity > 0.01) AS rare_logs, count(*) AS total_logs FROM sc")
def count_rare(spark, sf):
    return T.count_rare(_looked_up(spark, sf))


@query("first_seen_template", f"""WITH {LOGS}{TEMPLATES} SELECT template, event_id, timestamp FROM (SELECT *, row_number() OVER
 (PARTITION BY template ORDER BY timestamp, event_id) AS rn FROM tlogs) WHERE rn = 1""")
def first_seen_template(spark, sf):
    return T.first_seen_template(logs_of(spark, sf)).select("template", "event_id", "timestamp")


@query("new_templates_per_hour", f"""WITH {LOGS}{TEMPLATES}, f AS (SELECT template, min(timestamp) AS timestamp FROM tlogs GROUP BY 1)
 SELECT {HB} AS timestamp, count(*) AS new_templates FROM f GROUP BY 1""")
def new_templates_per_hour(spark, sf):
    return T.new_templates_per_hour(logs_of(spark, sf))


@query("template_drift", f"""WITH {LOGS}{TEMPLATES}, per AS (SELECT time_bucket(INTERVAL '1 day', timestamp) AS timestamp, template, count(*) AS n FROM tlogs GROUP BY 1, 2),
 tot AS (SELECT timestamp, sum(n) AS total FROM per GROUP BY 1), born AS (SELECT template, min(timestamp) AS born FROM per GROUP BY 1),
 now AS (SELECT per.*, born FROM per JOIN born USING (template)),
 last AS (SELECT timestamp + INTERVAL 1 DAY AS timestamp, template, n AS n_before, n / total AS share_before FROM per JOIN tot USING (timestamp)
   WHERE timestamp + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM tot)),
 j AS (SELECT coalesce(now.timestamp, last.timestamp) AS timestamp, coalesce(now.template, last.template) AS template, n, n_before,
   CASE WHEN n IS NULL THEN 'vanished' WHEN born = now.timestamp THEN 'new' WHEN share_before < 0.01 AND n >= 3.0 * n_before THEN 'spike' END AS drift
   FROM now FULL JOIN last ON now.timestamp = last.timestamp AND now.template = last.template)
 SELECT timestamp, template, drift, coalesce(n, 0) AS n, coalesce(n_before, 0) AS n_before FROM j WHERE drift IS NOT NULL""")
def template_drift(spark, sf):
    return T.template_drift(logs_of(spark, sf))


@query("inject_incidents", f"""WITH {LOGS} SELECT anomaly_type, count(*) AS n, count(DISTINCT level) AS n_levels FROM (
 SELECT 'security_breach' AS anomaly_type, CASE WHEN i < 15 THEN 'WARN' ELSE 'ERROR' END AS level
   FROM (SELECT event_id FROM logs WHERE is_anomaly = 1), range(20) r(i)) GROUP BY 1""")
def inject(spark, sf):
    logs = logs_of(spark, sf)
    seeds = P.filter_label(logs, 1).select(F.col("event_id").alias("incident_id"), "timestamp", "service",
                                           F.lit("security").alias("kind"), F.lit(20).alias("size"))
    added = inject_incidents(logs, seeds).filter(F.col("event_id").isNull())
    return added.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("level").alias("n_levels"))


# ---- single expressions --------------------------------------------------------------------------

@query("iso_format", f"WITH {LOGS} SELECT event_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM logs")
def iso(spark, sf):
    return logs_of(spark, sf).select("event_id", iso_format("timestamp").alias("iso"))


@query("message_prefix", f"WITH {LOGS} SELECT event_id, substring(message, 1, 50) AS prefix FROM logs")
def prefix(spark, sf):
    return logs_of(spark, sf).select("event_id", message_prefix("message").alias("prefix"))


@query("round_pct", f"WITH {LOGS} SELECT {HB} AS timestamp, round_even(sum(is_anomaly) / count(*) * 100, 2) AS anomaly_pct FROM logs GROUP BY 1")
def pct(spark, sf):
    hourly = W.group_by_window(logs_of(spark, sf), [F.sum("is_anomaly").alias("a"), F.count(F.lit(1)).alias("n")], H)
    return hourly.select("timestamp", round_pct(F.col("a") / F.col("n") * 100).alias("anomaly_pct"))


@query("drop_cols", f"WITH {LOGS}{volume_sql('1 hour')} SELECT * EXCLUDE (timestamp) FROM vol")
def drop_cols(spark, sf):
    return W.volume_features(logs_of(spark, sf), H).drop("timestamp")
