"""Streaming behaviour beyond batch equality (which the registered queries check)."""

import glob

from pyspark.sql import functions as F

from tidewatch.catalog import streams as S
from tidewatch.operators.results import alarm_lines
from tidewatch.operators.templates import first_seen_template
from tidewatch.operators.textmodel import fit_text_model
from tidewatch.plans.detect import fit_detector
from tidewatch.plans.features import all_features
from tidewatch.session import fresh_path
from tidewatch.sources.logs import read_events
from tidewatch.sources.sinks import read_results
from tidewatch.streaming import detect as SD
from tidewatch.streaming import features as SF
from tidewatch.streaming import state as ST


def test_late_rows_are_dropped_and_counted(spark, sf):
    late = F.expr("event_id % 50 = 0")
    part = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10)
    path = S.replay(spark, sf, F.when(late, part + 3).otherwise(part), parts=6)
    q = SD.each_batch(SF.stream_volume(S.opened(spark, path), "1 hour", "1 hour"), S.keep(fresh_path(spark, "o")), fresh_path(spark, "cp"))
    q.awaitTermination()
    total = SD.counters(q)
    assert total["dropped_late"] > 0
    assert total["logs"] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_quarantine_keeps_the_stream_running(spark, tmp_path):
    rows = ['{"timestamp":"2024-01-01T00:00:00Z","level":"INFO","message":"m"}', "{broken", '{"timestamp":"never"}']
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    raw = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    SD.start_quarantine(raw, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert sum(len(open(f).read().split()) for f in glob.glob(f"{tmp_path}/bad/*/part-*")) == 2


def test_alarms_use_the_raw_table(spark, sf, tmp_path):
    logs = read_events(spark, sf)
    model = fit_detector(logs, "1 day", 1.0, 3)
    raw, out, alarms = (str(tmp_path / n) for n in ("raw", "out", "alarms"))
    SD.start_raw_sink(S.opened(spark, S.replay(spark, sf, parts=1)), raw, str(tmp_path / "cp1")).awaitTermination()
    SD.start_detection(S.opened(spark, S.replay(spark, sf, parts=1)), model, "1 day", out, str(tmp_path / "cp2"), "60 days",
                       raw_path=raw, alarms_path=alarms).awaitTermination()
    results = read_results(spark, out, "last")
    assert results.filter("is_anomaly = 1").count() > 0
    want = alarm_lines(results, logs, "1 day").select("line")
    got = spark.read.text(f"{alarms}/*")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_first_sightings_bring_their_state_store(spark, sf):
    key = "spark.sql.streaming.stateStore.providerClass"
    before, plain = spark.conf.get(key), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(key, plain)
    try:
        out = S._sightings(spark, sf)
        assert spark.conf.get(key) == plain
    finally:
        spark.conf.set(key, before)
    found = {(r.template, r.event_id) for r in ST.read_first_sightings(spark, out).collect()}
    assert found == {(r.template, r.event_id) for r in first_seen_template(read_events(spark, sf)).collect()}


def test_templates_that_the_model_does_not_know_count_as_in_a_batch(spark, sf, tmp_path):
    logs = read_events(spark, sf)
    seen = logs.filter("message LIKE 'Cache%' OR message LIKE 'Slow%'")
    model = fit_text_model(seen, k=3, restarts=1)
    model.extremes = (0.0, 1.0)
    message = F.when(F.expr("event_id % 7 = 0"), F.lit("")).when(F.expr("event_id % 11 = 0"), F.lit("cache slow cache lookup slow cache key")).otherwise(F.col("message"))
    logs.withColumn("message", message).coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = SF.stream_features(SF.file_stream(spark, str(tmp_path / "in"), stored.schema), model, "1 day", "60 days")
    assert " run(" not in stream._jdf.queryExecution().analyzed().toString()  # a log goes to no task function
    SD.each_batch(stream, S.keep(out), str(tmp_path / "cp")).awaitTermination()
    want = {r.timestamp: r for r in all_features(stored, model, "1 day").collect()}
    got = read_results(spark, out, "last").collect()
    assert len(got) == len(want) > 0
    for r in got:
        assert all(abs(r[c] - want[r.timestamp][c]) < 1e-9 for c in want[r.timestamp].asDict() if c != "timestamp")


def test_an_arrival_of_many_events_is_several_files_and_one_batch(spark, sf, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 300, raising=False)
    path = S.replay(spark, sf, parts=2)
    assert len(glob.glob(f"{path}/*.parquet")) == 8
    sizes = []
    SD.each_batch(S.opened(spark, path), lambda batch, i: sizes.append((i, batch.select(F.count_if(F.expr("event_id % 2 = 1")), F.count(F.lit(1))).first())), fresh_path(spark, "cp"), "append").awaitTermination()
    assert [tuple(r) for _, r in sorted(sizes)] == [(0, 500), (500, 500)]
