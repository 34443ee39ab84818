"""Log sources.  Every reader yields the same log columns with a TIMESTAMP key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalar import parse_iso_ts
from tidewatch.schemas import LOG_SCHEMA, TRAINING_LOG_SCHEMA
from tidewatch.session import ensure_utc

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def events_as_logs(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Map the ``events`` table (batch or stream) onto log records; ``keep`` names columns to carry along."""
    kind, value = F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")
    critical = kind == "error"
    text = lambda c: c.cast("string")
    flag = F.when(critical & (value >= 150), 1).otherwise(0)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(critical & (value >= 60), "FATAL").when(critical, "ERROR").when(kind == "signup", "WARN")
        .when(kind == "click", "DEBUG").otherwise("INFO").alias("level"),
        F.concat(F.lit("svc-"), text(F.col("user_id") % 7)).alias("service"),
        F.when(kind == "view", F.concat(F.lit("GET /api/items/"), text(F.col("user_id") % 50),
                                        F.lit(" served to user_"), text(F.col("user_id"))))
        .when(kind == "click", F.concat(F.lit("Cache lookup key cache_"), text(k)))
        .when(kind == "signup", F.concat(F.lit("Slow call "), text(F.col("event_id") % 500), F.lit("ms from 10.0."),
                                         text(F.col("user_id") % 256), F.lit(".7")))
        .when(kind == "purchase", F.concat(F.lit("Payment accepted amount "), text(value.cast("decimal(18,2)"))))
        .otherwise(F.concat(F.lit("Upstream db-"), text(F.col("user_id") % 5), F.lit(" timeout code "),
                            F.char(F.lit(65) + k % 26))).alias("message"),
        flag.alias("is_anomaly"),
        F.when(flag == 1, "spike").alias("anomaly_type"),
        *keep,
    )


def read_events(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    ensure_utc(spark)
    return events_as_logs(spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet"), keep)


def read_parquet_logs(spark: SparkSession, path: str) -> DataFrame:
    """Training logs; text timestamps are parsed, typed ones kept."""
    ensure_utc(spark)
    df = spark.read.parquet(path)
    kind = dict(df.dtypes)["timestamp"]
    ts = parse_iso_ts("timestamp") if kind == "string" else F.col("timestamp").cast("timestamp")
    return df.withColumn("timestamp", ts)


def read_csv_logs(spark: SparkSession, path: str, schema: T.StructType = TRAINING_LOG_SCHEMA) -> DataFrame:
    ensure_utc(spark)
    return (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
        .withColumn("timestamp", parse_iso_ts("timestamp"))
    )


def split_bad_csv(spark: SparkSession, path: str, schema: T.StructType = TRAINING_LOG_SCHEMA, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good logs, quarantine) of CSV files; together they hold every record.

    A record is bad when it does not fit the schema or its time cannot be read.
    The quarantine names its ``file``, the byte at which the split begins that
    holds it (``split_at``, 0 unless a large file is split) and its number
    there from 0 (``record``), with the raw record or the time's text.
    ``multiline`` reads quoted line ends as part of a value; such a file is one
    split, so very large files without them are better read with it off.
    """
    ensure_utc(spark)
    wide = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(wide).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    at = {"file": F.col("_metadata.file_path"), "split_at": F.col("_metadata.file_block_start"), "_n": F.monotonically_increasing_id()}
    parsed = rows.withColumns(at).withColumns({"_text": F.col("timestamp"), "timestamp": parse_iso_ts("timestamp")})
    wrong = F.col("_bad").isNotNull() | F.col("timestamp").isNull()
    first = rows.withColumns(at).groupBy("file", "split_at").agg(F.min("_n").alias("_first"))  # a row per split
    bad = parsed.filter(wrong).join(first, ["file", "split_at"])
    reason = F.when(F.col("_bad").isNotNull(), "record").otherwise("timestamp")
    return parsed.filter(~wrong).select(*schema.fieldNames()), bad.select(
        "file", "split_at", (F.col("_n") - F.col("_first")).alias("record"), reason.alias("reason"), F.coalesce("_bad", "_text").alias("corrupt"))


def split_bad_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good logs, quarantine) of Parquet files with text times; the quarantine has ``file`` and ``record``, the row's number in it."""
    ensure_utc(spark)
    rows = spark.read.parquet(path)
    if dict(rows.dtypes)["timestamp"] != "string":
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("string"))
    at = {"file": F.col("_metadata.file_path"), "record": F.col("_metadata.row_index")}
    parsed = rows.withColumns(at).withColumns({"_text": F.col("timestamp"), "timestamp": parse_iso_ts("timestamp")})
    bad = parsed.filter(F.col("timestamp").isNull())
    return parsed.filter(F.col("timestamp").isNotNull()).select(*rows.columns), bad.select("file", "record", F.lit("timestamp").alias("reason"), F.col("_text").alias("corrupt"))


def decode_json_logs(df: DataFrame, value: str = "value", schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """JSON text -> typed log columns plus ``corrupt`` (the raw text, when unusable).

    Malformed JSON and unparseable timestamps are both marked, so a quarantine is
    one filter away; other columns of the input are passed through.
    """
    wide = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    raw = F.col(value).cast("string")
    parsed = F.from_json(raw, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in df.columns if c != value]
    out = df.select(*rest, raw.alias("_raw"), parsed.alias("_p"))
    ts = parse_iso_ts("_p.timestamp")
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull() | ts.isNull()
    return out.select(
        *rest,
        ts.alias("timestamp"),
        *[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields if f.name != "timestamp"],
        F.when(bad, F.coalesce("_raw", F.lit(""))).alias("corrupt"),
    )


def split_corrupt(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good logs, quarantine).  One bad record never stops or loses a window."""
    good = decoded.filter(F.col("corrupt").isNull()).drop("corrupt")
    return good, decoded.filter(F.col("corrupt").isNotNull()).select("corrupt")


def kafka_logs(spark: SparkSession, servers: str, topic: str = "log-events", max_per_trigger: int | None = None,
               **options: str) -> DataFrame:
    """Streaming log records from a broker topic, decoded; the broker's own time is kept as ``ingest_time``.

    Needs the Kafka connector on the class path.  Offsets live in the query's
    checkpoint, so nothing is committed before it has been processed.
    """
    ensure_utc(spark)
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    for key, val in options.items():
        reader = reader.option(key, val)
    raw = reader.load().select("value", F.col("timestamp").alias("ingest_time"))
    return decode_json_logs(raw)
