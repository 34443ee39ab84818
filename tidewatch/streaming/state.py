"""Streaming operators with state of their own: one value per template, and a timer that makes it final."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidewatch.operators.templates import with_template
from tidewatch.operators.windows import group_by_window
from tidewatch.session import STATE_STORE
from tidewatch.streaming.detect import each_batch

SIGHTING = "template string, us long, event_id long, final boolean"


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first log of each template in a task; a template that floods the stream leaves the task as one row."""
    best: dict[str, tuple[int, int]] = {}
    for batch in batches:
        for template, us, event in zip(*(c.to_pylist() for c in batch.columns)):
            if template is not None and us is not None and (template not in best or (us, event) < best[template]):
                best[template] = (us, event)
    if best:
        yield pa.RecordBatch.from_arrays(
            [pa.array(best), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64())], names=["template", "us", "event_id"])


class FirstSighting(StatefulProcessor):
    """State per template: its earliest log so far.  Emits a row whenever that changes, and a final one by timer."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "us long, event_id long")

    def _row(self, key, us: int, event: int, final: bool) -> pd.DataFrame:
        return pd.DataFrame({"template": [key[0]], "us": [us], "event_id": [event], "final": [final]})

    def handleInputRows(self, key, rows, timerValues):
        best = min((int(u), int(e)) for pdf in rows for u, e in zip(pdf["us"], pdf["event_id"]))
        held = tuple(self.first.get()) if self.first.exists() else None
        if held is None or best < held:
            self.first.update(best)
            if self.timed:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(best[0] // 1000 + 1)
            yield self._row(key, *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._row(key, *self.first.get(), True)

    def close(self) -> None:
        pass


def first_sightings(logs: DataFrame, watermark: str | None = None) -> DataFrame:
    """(template, timestamp, event_id, final) of a stream of logs; a later row of a template replaces an earlier one.

    Without a watermark no log is too late: an earlier sighting that arrives
    late corrects the first one, and nothing is ever final.  With one, a
    sighting is marked final as soon as the watermark has passed it, for
    nothing earlier is accepted from then on.  Logs are reduced to one row per
    task and template before the shuffle; logs without a message or time are
    left out.
    """
    rows = with_template(logs).select("template", F.unix_micros("timestamp").alias("us"), "event_id")
    least = rows.mapInArrow(_earliest, "template string, us long, event_id long")
    if watermark:
        least = least.withColumn("timestamp", F.timestamp_micros("us")).withWatermark("timestamp", watermark)
    found = least.groupBy("template").transformWithStateInPandas(FirstSighting(watermark is not None), SIGHTING, "Update", "EventTime" if watermark else "None")
    return found.select("template", F.timestamp_micros("us").alias("timestamp"), "event_id", "final")


def start_first_sightings(logs: DataFrame, path: str, checkpoint: str, watermark: str | None = None, every: str | None = None) -> StreamingQuery:
    """Changes of first sightings to a table, one folder per batch; replaying a batch rewrites its folder.

    Values and timers need RocksDB state, so the query brings that setting along, whatever the session has.
    """
    handle = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")
    return each_batch(first_sightings(logs, watermark), handle, checkpoint, "update", every, settings=STATE_STORE)


def read_first_sightings(spark: SparkSession, path: str) -> DataFrame:
    """(template, timestamp, event_id, final): the current first sighting of each template, the batch operator's answer."""
    first = F.struct("timestamp", "event_id")
    rows = spark.read.parquet(path).groupBy("template").agg(F.min(first).alias("first"), F.max(F.struct(F.col("final"), F.negate(F.unix_micros("timestamp")))).alias("last"))
    return rows.select("template", "first.timestamp", "first.event_id", F.col("last.final").alias("final"))


def new_templates_stored(spark: SparkSession, path: str) -> DataFrame:
    """New templates per hour from the stored sightings; a corrected sighting moves to its hour."""
    return group_by_window(read_first_sightings(spark, path), [F.count(F.lit(1)).alias("new_templates")], "1 hour")
