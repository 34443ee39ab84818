"""Physical plans: what is shuffled, pushed down and limited early."""

import re


from tidewatch.operators import templates as T
from tidewatch.operators import windows as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_volume_features_shuffle_once_and_read_two_columns(logs):
    text = plan(W.volume_features(logs, "1 hour"))
    assert text.count("Exchange") == 1 and "partial_count" in text
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>", text)


def test_rank_limits_run_before_the_shuffle(logs):
    for df in (W.sample_errors(logs, "1 hour"), T.first_seen_template(logs)):
        text = plan(df)
        assert "Partial" in text and "WindowGroupLimit" in text


def test_no_single_partition_window_over_logs(logs):
    text = plan(W.rolling_stats(W.volume_features(logs, "30 seconds"), ["log_count"], {"5min": 300}))
    assert "SinglePartition" not in text


def test_level_filter_reaches_the_scan(spark, tmp_path, logs):
    logs.write.parquet(str(tmp_path / "l"))
    text = plan(spark.read.parquet(str(tmp_path / "l")).filter("level = 'FATAL'").select("event_id"))
    assert "EqualTo(level,FATAL)" in text


def test_no_cartesian_products(logs):
    for df in (T.template_drift(logs), W.gap_fill(W.window_counts(logs), "30 seconds")):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_task_functions_need_no_package_on_executors(tmp_path):
    """A kernel pickled here runs in an interpreter that cannot import this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tidewatch.operators.dbscan import _count_kernel

    code = "import sys, pickle; run = pickle.load(sys.stdin.buffer); print(len(list(run(iter([])))))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(_count_kernel((1.0,), 2)), cwd=tmp_path, capture_output=True)
    assert done.stdout.strip() == b"0", done.stderr
