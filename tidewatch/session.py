"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC clock, AQE and reliable-checkpoint clean-up switched on.

    Nothing here is sized for one machine: shuffle width is left to the cluster
    (AQE coalesces), and callers override any key through ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **STATE_STORE,
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> None:
    """All time arithmetic in this package assumes a UTC session clock."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made up only for ``local[...]`` masters, where the
    driver and its executors are the same process; on a cluster a missing
    setting is an error, because lost executors could not be recovered from it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster[...] has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidewatch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


_scopes = threading.local()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, empty path below the shared folder, or below the folder of the scope that is open in this thread."""
    open_scopes = getattr(_scopes, "paths", [])
    root = open_scopes[-1] if open_scopes else f"{shared_dir(spark)}/tidewatch"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Inside, the session has these settings; afterwards, what it had before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables settled inside live until the block ends; what is read from them must be written out before.

    Gives a plan or a micro-batch scratch of its own, so a long stream leaves
    nothing behind.
    """
    path = fresh_path(spark, "scope")
    _scopes.paths = [*getattr(_scopes, "paths", []), path]
    try:
        yield path
    finally:
        _scopes.paths = _scopes.paths[:-1]
        delete_path(spark, path)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver's memory is next cleaned.

    For a chain of large steps that each write a table: nothing after a step
    reads its shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_stage_paths: dict[tuple[str, int], str] = {}


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[str]:
    """Scratch of one of several steps in a row: what is settled inside lives until the next step of this thread opens its own.

    For steps whose results are lazy and are written out between them: the
    tables of a step are still read while its result is written, and no longer
    when the next one begins.
    """
    key = (spark.sparkContext.applicationId, threading.get_ident())
    if key in _stage_paths:
        delete_path(spark, _stage_paths.pop(key))
    path = _stage_paths[key] = fresh_path(spark, "stage")
    _scopes.paths = [*getattr(_scopes, "paths", []), path]
    try:
        yield path
    finally:
        _scopes.paths = _scopes.paths[:-1]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors.

    Used where a plan is read several times or where row placement must not be
    decided twice.  The table's real size is then known to the planner, so a
    later broadcast is chosen by measured bytes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this package has put below the shared folder."""
    delete_path(spark, f"{shared_dir(spark)}/tidewatch")
