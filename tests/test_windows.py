"""Micro-tables for the window and cleaning semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.scalar import alarm_text, nan_inf_to_zero, score_band
from tidewatch.functions.text import normalize_message, normalize_message_v2, tokenize_ngrams
from tidewatch.operators import profiles as P
from tidewatch.operators import results as R
from tidewatch.operators import windows as W
from tidewatch.operators.evaluation import precision_recall_f1
from tidewatch.operators.templates import first_seen_template
from tidewatch.sources.logs import decode_json_logs, kafka_logs, split_corrupt

SCHEMA = "event_id long, timestamp timestamp, level string, service string, message string, is_anomaly int"


def at(h=0, m=0, s=0):
    return dt.datetime(2024, 1, 1, h, m, s)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lv, "a", "m", 0) for i, (t, lv) in enumerate(rows)], SCHEMA)


def test_empty_input(spark):
    assert W.volume_features(table(spark, [])).count() == 0


def test_one_row(spark):
    row = W.volume_features(table(spark, [(at(), "ERROR")])).first()
    assert (row.log_count, row.error_rate, row.critical_rate, row.warn_to_info_ratio) == (1, 1.0, 1.0, 0.0)


def test_warnings_without_info_keep_their_count(spark):
    row = W.volume_features(table(spark, [(at(), "WARN"), (at(0, 0, 1), "WARN")])).first()
    assert row.warn_to_info_ratio == 2.0


def test_unknown_level_counts_only_in_total(spark):
    row = W.volume_features(table(spark, [(at(), "TRACE"), (at(), "INFO")])).first()
    assert row.log_count == 2 and row.info_count == 1 and row.debug_count == 0


def test_edge_row_opens_the_next_bin(spark):
    rows = W.window_counts(table(spark, [(at(0, 0, 29), "INFO"), (at(0, 0, 30), "INFO")])).orderBy("timestamp").collect()
    assert [r.log_count for r in rows] == [1, 1]


def test_empty_middle_bins_are_zero(spark):
    out = W.volume_features(table(spark, [(at(0, 0, 0), "INFO"), (at(0, 2, 0), "WARN")]), fill_gaps=True).orderBy("timestamp").collect()
    assert [r.log_count for r in out] == [1, 0, 0, 0, 1] and out[2].error_rate == 0.0


def test_gap_fill_across_midnight(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 59, 0), "INFO"), (dt.datetime(2024, 1, 2, 0, 1, 0), "INFO")]
    assert W.volume_features(table(spark, rows), fill_gaps=True).count() == 5


def test_counts_sum_to_rows(logs):
    for width in ("30 seconds", "7 minutes", "1 day"):
        assert W.window_counts(logs, width).agg(F.sum("log_count")).first()[0] == logs.count()


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (float("-inf"), None), (None, 3), (2.5, 4)], "x double, n int")
    assert [tuple(r) for r in nan_inf_to_zero(df).collect()] == [(0.0, 1), (0.0, 2), (0.0, 0), (0.0, 3), (2.5, 4)]


@pytest.mark.parametrize("score,band", [(0.29, "normal"), (0.3, "borderline"), (0.6, "borderline"), (0.61, "likely"), (0.8, "likely"), (0.81, "definite")])
def test_bands(spark, score, band):
    assert spark.range(1).select(score_band(F.lit(score))).first()[0] == band


def test_normaliser_runs_digits_first(spark):
    df = spark.createDataFrame([("GET /api/users/12/x",), ("  user_42 waited 15ms at 10.0.0.7 \t",)], "m string")
    assert [r[0] for r in df.select(normalize_message("m")).collect()] == [
        "get <PATH><NUM><PATH>", "user_<NUM> waited <NUM>ms at <NUM>.<NUM>.<NUM>.<NUM>"]
    assert df.select(normalize_message_v2("m")).collect()[1][0] == "user_<ID> waited <DURATION>ms at <IP>"


def test_ngrams(spark):
    df = spark.createDataFrame([("the cache Lookup of a key <NUM>",), ("",), ("one",)], "m string")
    assert [r[0] for r in df.select(tokenize_ngrams("m")).collect()] == [
        ["cache", "lookup", "key", "num", "cache lookup", "lookup key", "key num"], [], ["one"]]


def test_bad_records_are_quarantined(spark):
    rows = ['{"timestamp":"2024-01-01T00:00:00.123Z","level":"INFO","service":"a","message":"m","is_anomaly":1}', "{broken",
            '{"timestamp":"yesterday","level":"INFO"}', '{"timestamp":"2024-01-01T00:00:01Z","level":"WARN"}', None]
    good, bad = split_corrupt(decode_json_logs(spark.createDataFrame([(r,) for r in rows], "value string")))
    assert sorted(r.level for r in good.collect()) == ["INFO", "WARN"]
    assert sorted(r.corrupt for r in bad.collect()) == ["", '{"timestamp":"yesterday","level":"INFO"}', "{broken"]


def test_first_seen_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(2, at(), "INFO", "a", "m 1", 0), (1, at(), "INFO", "a", "m 2", 0)], SCHEMA)
    assert [r.event_id for r in first_seen_template(df).collect()] == [1]


def test_upsert_keeps_first_truth(spark):
    rows = [(at(), at(), 0.1, 0, 1, 1), (at(), at(), 0.9, 1, 0, 2)]
    df = spark.createDataFrame(rows, "timestamp timestamp, window_start timestamp, anomaly_score double, is_anomaly int, ground_truth int, arrival long")
    row = R.results_latest(df).first()
    assert (row.anomaly_score, row.is_anomaly, row.ground_truth) == (0.9, 1, 1)


def test_alarm_layout(spark):
    df = spark.createDataFrame([(0.98765, at(), at(0, 0, 30), 16, 1, 2)],
                               "anomaly_score double, window_start timestamp, window_end timestamp, log_count long, error_count long, critical_count long")
    assert df.select(alarm_text()).first()[0] == (
        "ANOMALY DETECTED | Score: 0.988 | Window: 2024-01-01T00:00:00.000Z to 2024-01-01T00:00:30.000Z | Logs: 16 | Errors: 1 (6.2%) | Critical: 2")


@pytest.mark.parametrize("flags", [[0, 0, 0], [1, 1, 1]])
def test_degenerate_flags_score_zero(spark, flags):
    df = spark.createDataFrame([(t, p) for t, p in zip([0, 1, 0], flags)], "t int, p int")
    assert tuple(precision_recall_f1(df, "t", "p", degenerate_zero=True).first()) == (0.0, 0.0, 0.0)


def test_sample_is_repeatable(logs):
    pick = lambda: {r.event_id for r in P.sample_rows(logs, 50, "event_id").collect()}
    assert pick() == pick() and len(pick()) == 50


def test_kafka_source_contract(spark):
    """Without the connector the reader fails on the missing source and on nothing else."""
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_logs(spark, "localhost:1", "log-events")
