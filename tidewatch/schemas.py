"""Schemas of the tables at the edges of the library."""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("is_anomaly", T.IntegerType()),
])

TRAINING_LOG_SCHEMA = T.StructType(LOG_SCHEMA.fields + [T.StructField("anomaly_type", T.StringType())])

RESULT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("cluster_label", T.IntegerType()),
    T.StructField("log_count", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("critical_count", T.LongType()),
    T.StructField("ground_truth", T.IntegerType()),
])

# Severity names and the column order of the feature vector.
LEVELS = ["ERROR", "FATAL", "WARN", "INFO", "DEBUG"]
CRITICAL_LEVELS = ["ERROR", "FATAL"]
COUNT_COLS = ["log_count", "error_count", "fatal_count", "warn_count", "info_count", "debug_count"]
RATE_COLS = ["error_rate", "fatal_rate", "warn_rate", "warn_to_info_ratio", "critical_count", "critical_rate"]
VOLUME_COLS = COUNT_COLS + RATE_COLS
TEXT_DIMS = 15
TEXT_COLS = ["message_rarity", "message_anomaly_score", "message_cluster"] + [f"tfidf_{i}" for i in range(TEXT_DIMS)]

# Default hyper-parameters and thresholds.
WINDOW_WIDTH = "30 seconds"
DBSCAN_EPS = 15.0
DBSCAN_MIN_SAMPLES = 15
SCORE_ALERT = 0.7
RATE_ALERT = 0.1
RARE_ABOVE = 0.01
MAX_LATENCY_SECONDS = 33.0
