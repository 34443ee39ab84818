"""Tumbling windows, volume features, gap filling and trailing statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import ratio
from tidewatch.schemas import COUNT_COLS, CRITICAL_LEVELS, LEVELS, VOLUME_COLS, WINDOW_WIDTH
from tidewatch.session import settle


def bin_start(ts: str, width: str, start_time: str | None = None) -> Column:
    """Grouping key: left-closed bin.  Widths that do not divide a day need ``start_time``."""
    return F.window(ts, width, None, start_time) if start_time else F.window(ts, width)


CHUNK_BINS = 10_000


def width_micros(spark: SparkSession, width: str) -> int:
    """Length of a fixed window width in microseconds."""
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {width}"))).first()[0]


def first_midnight(logs: DataFrame, width: str, ts: str = "timestamp") -> str:
    """``start_time`` that lets bins of any width begin at the midnight before the first log."""
    first = logs.agg(F.unix_micros(F.date_trunc("day", F.min(ts)))).first()[0] or 0
    return f"{first % width_micros(logs.sparkSession, width)} microseconds"


def tumbling(df: DataFrame, width: str = WINDOW_WIDTH, ts: str = "timestamp", start_time: str | None = None) -> DataFrame:
    """Add ``window_start`` / ``window_end`` to every row."""
    return (
        df.withColumn("_w", bin_start(ts, width, start_time))
        .withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
    )


def level_indicators(df: DataFrame) -> DataFrame:
    return df.withColumns({f"is_{lv.lower()}": (F.col("level") == lv).cast("int") for lv in LEVELS})


def count_aggs() -> list[Column]:
    """Row count and per-level counts; partial aggregation happens before the shuffle."""
    return [F.count("level").alias("log_count")] + [
        F.count_if(F.col("level") == lv).alias(f"{lv.lower()}_count") for lv in LEVELS
    ]


def group_by_window(df: DataFrame, aggs: Sequence[Column], width: str, ts: str = "timestamp",
                    keys: Sequence[str] = (), start_time: str | None = None) -> DataFrame:
    """One shuffle: group by bin (and ``keys``), label rows with the bin start."""
    out = df.groupBy(bin_start(ts, width, start_time).alias("_w"), *keys).agg(*aggs)
    names = [c for c in out.columns if c not in ("_w", *keys)]
    return out.select(F.col("_w.start").alias("timestamp"), *keys, *names)


def window_counts(logs: DataFrame, width: str = WINDOW_WIDTH, start_time: str | None = None) -> DataFrame:
    return group_by_window(logs, count_aggs(), width, start_time=start_time)


def window_rates(counts: DataFrame) -> DataFrame:
    """Six derived columns on top of the counts."""
    critical = F.col("error_count") + F.col("fatal_count")
    return counts.withColumns({
        "error_rate": ratio("error_count", "log_count"),
        "fatal_rate": ratio("fatal_count", "log_count"),
        "warn_rate": ratio("warn_count", "log_count"),
        "warn_to_info_ratio": ratio("warn_count", "info_count"),
        "critical_count": critical,
        "critical_rate": ratio(critical, "log_count"),
    })


def volume_features(logs: DataFrame, width: str = WINDOW_WIDTH, fill_gaps: bool = False, start_time: str | None = None) -> DataFrame:
    """The 12 volume features per window, in contract order; ``start_time`` shifts the bins (see ``first_midnight``)."""
    counts = window_counts(logs, width, start_time)
    if fill_gaps:
        counts = gap_fill(counts, width)
    return window_rates(counts).select("timestamp", *VOLUME_COLS)


def gap_fill(windows: DataFrame, width: str, ts: str = "timestamp", fills: Mapping[str, object] | None = None) -> DataFrame:
    """Add the empty bins between the first and last occupied bin.

    Bin i begins at the first occupied bin plus i widths, whatever the width.
    Bin numbers are cut into chunks before they are expanded, so a long history
    is generated in parallel.  The windows are kept as a table first: they are
    read for the span and for the join.  A window that does not fall on the
    grid is an error, not a lost row.  Numeric columns default to 0.
    """
    windows = settle(windows)
    step = width_micros(windows.sparkSession, width)
    lo, hi = windows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if lo is None:
        return windows
    if not windows.filter((F.unix_micros(ts) - lo) % step != 0).isEmpty():
        raise ValueError(f"windows do not lie {width} apart; give all of them the same width and start")
    last = (hi - lo) // step
    chunks = windows.sparkSession.range(last // CHUNK_BINS + 1)
    first = F.col("id") * CHUNK_BINS
    number = F.explode(F.sequence(first, F.least(first + CHUNK_BINS - 1, F.lit(last))))
    bins = chunks.select(number.alias("_i")).select(F.timestamp_micros(F.lit(lo) + F.col("_i") * F.lit(step)).alias(ts))
    joined = bins.join(windows, ts, "left")
    if fills is None:
        fills = {c: 0 for c, t in windows.dtypes if t in ("bigint", "int", "double", "float")}
    return joined.fillna(dict(fills)) if fills else joined


def window_labels(logs: DataFrame, width: str = WINDOW_WIDTH) -> DataFrame:
    """A window is anomalous when any of its logs is."""
    return group_by_window(logs, [F.max("is_anomaly").alias("is_anomaly")], width)


def summary_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("log_count"),
        F.count_if(F.col("level") == "ERROR").alias("error_count"),
        F.count_if(F.col("level").isin(CRITICAL_LEVELS)).alias("critical_count"),
        F.coalesce(F.max("is_anomaly"), F.lit(0)).alias("ground_truth"),
    ]


def buffer_summary(logs: DataFrame, width: str = WINDOW_WIDTH) -> DataFrame:
    """Totals reported with each detection, per event-time window."""
    return group_by_window(logs, summary_aggs(), width)


def multi_width(logs: DataFrame, base: str, widths: Sequence[str]) -> DataFrame:
    """Counts at several widths from one pass: aggregate at ``base``, roll the partials up.

    Every width must be a multiple of ``base``; the raw logs are scanned and
    shuffled once, the roll-ups read the small partial table.
    """
    return roll_widths(settle(window_counts(logs, base)), widths)


def roll_widths(partial: DataFrame, widths: Sequence[str]) -> DataFrame:
    """Counts of narrow windows (timestamp, counts) at several widths, multiples of theirs."""
    rolled = None
    for width in widths:
        part = group_by_window(partial, [F.sum(c).alias(c) for c in COUNT_COLS], width)
        part = part.select(F.lit(width).alias("width"), "timestamp", *COUNT_COLS)
        rolled = part if rolled is None else rolled.unionByName(part)
    return rolled


ROLL_BLOCKS = 4  # a block is so many times the widest span long: a quarter of the rows is read twice


def rolling_stats(windows: DataFrame, cols: Sequence[str], spans: Mapping[str, int], step_seconds: int = 30,
                  ts: str = "timestamp") -> DataFrame:
    """Trailing mean, max, min, std and p95 of per-window columns.

    ``spans`` maps a suffix to a trailing length in seconds.  Time is cut into
    blocks; rows near the end of a block are copied into the next one, so each
    block holds the history it needs and blocks run in parallel.  Inside a
    block every statistic slides: sums are kept up to date, extremes come from
    a queue, p95 from an ordered skip list, so a row costs the same (a
    logarithm of the span for p95) however long the span is.  Rows with equal
    times see each other; nulls do not count.
    """
    reach = max(spans.values())
    length = ROLL_BLOCKS * reach
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    own, after = F.floor(us / F.lit(length * 10**6)), F.floor((us + F.lit(reach * 10**6)) / F.lit(length * 10**6))
    spread = windows.select(ts, us.alias("_us"), own.alias("_own"), *cols, F.explode(F.array_distinct(F.array(own, after))).alias("_block"))
    kinds, shown = dict(windows.dtypes), ["mean", "max", "min", "std", "p95"]
    names = [f"{c}_{k}_{suffix}" for suffix in spans for c in cols for k in shown]

    def slide(pdf):
        pdf = pdf.sort_values("_us", kind="stable")
        values = pdf[list(cols)].astype("float64").set_index(pd.to_datetime(pdf["_us"].to_numpy(), unit="us"))
        out = {}
        for suffix, span in spans.items():
            rolled = values.rolling(f"{span - step_seconds}s" if span > step_seconds else "1us", closed="both" if span > step_seconds else "right", min_periods=1)
            parts = [rolled.mean(), rolled.max(), rolled.min(), rolled.std().fillna(0.0), rolled.quantile(0.95, interpolation="linear")]
            for c in cols:
                out.update({f"{c}_{k}_{suffix}": part[c].to_numpy() for k, part in zip(shown, parts)})
        table = pd.DataFrame(out).groupby(pdf["_us"].to_numpy()).transform("last")  # peers see each other
        table.insert(0, "_us", pdf["_us"].to_numpy())
        return table[(pdf["_own"] == pdf["_block"]).to_numpy()]

    rolled = spread.select("_us", "_own", "_block", *cols).groupBy("_block").applyInPandas(slide, "_us long, " + ", ".join(f"{n} double" for n in names))
    back = F.timestamp_micros("_us") if kinds[ts] == "timestamp" else F.timestamp_micros("_us").cast(kinds[ts])
    whole = {f"{c}_{k}_{suffix}": kinds[c] for suffix in spans for c in cols for k in ("max", "min")}
    present = lambda n: F.when(~F.isnan(n), F.col(n)).cast(whole.get(n, "double")).alias(n)
    return rolled.select(back.alias(ts), *map(present, names))


def sample_errors(logs: DataFrame, width: str = WINDOW_WIDTH, n: int = 3, order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """First ``n`` ERROR/FATAL messages of each window.

    ``row_number() <= n`` lets Spark cut every map task's output to n rows per
    window before the shuffle, so a flooded window costs no more than others.
    """
    critical = tumbling(logs.filter(F.col("level").isin(CRITICAL_LEVELS)), width)
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(*order))
    return critical.withColumn("sample_no", rank).filter(F.col("sample_no") <= n)


def union_logs(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def join_volume_text(volume: DataFrame, text: DataFrame) -> DataFrame:
    """Left join for features kept in separate tables (``all_features`` needs no join)."""
    return volume.join(text, "timestamp", "left")


def join_feature_sets(left: DataFrame, right: DataFrame, suffix: str = "_text") -> DataFrame:
    """Inner join on the window; clashing columns of the right side get ``suffix``."""
    clash = (set(left.columns) & set(right.columns)) - {"timestamp"}
    renamed = right.withColumnsRenamed({c: f"{c}{suffix}" for c in clash})
    return left.join(renamed, "timestamp", "inner")


def join_window_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, "timestamp", "inner").withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(0)))
