"""Scalar expressions: cleaning, ratios, bands, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score bands, timestamp text layout, alarm layout.
BANDS = {"normal": 0.3, "borderline": 0.6, "likely": 0.8}
TOP_BAND = "definite"
ISO_LAYOUT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
ALARM_LAYOUT = "ANOMALY DETECTED | Score: %.3f | Window: %s to %s | Logs: %d | Errors: %d (%.1f%%) | Critical: %d"
SAMPLE_LAYOUT = "  Sample Error %d: %s"


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division whose zero denominator counts as one."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return num / F.greatest(den, F.lit(1))


def finite_or_zero(col: Column) -> Column:
    infinite = F.abs(col) == F.lit(float("inf"))
    return F.when(col.isNull() | F.isnan(col) | infinite, F.lit(0.0)).otherwise(col)


def nan_inf_to_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN, null and +-inf become 0 in the given (default: all numeric) columns."""
    kinds = dict(df.dtypes)
    numeric = {"double", "float", "bigint", "int", "smallint", "tinyint"}
    chosen = [c for c in (cols or df.columns) if kinds[c] in numeric]
    return df.withColumns({
        c: finite_or_zero(F.col(c)) if kinds[c] in ("double", "float") else F.coalesce(F.col(c), F.lit(0))
        for c in chosen
    })


def score_band(score: Column | str) -> Column:
    """below .3 normal, up to .6 borderline, up to .8 likely, above definite."""
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s < BANDS["normal"], "normal")
        .when(s <= BANDS["borderline"], "borderline")
        .when(s <= BANDS["likely"], "likely")
        .when(s.isNotNull(), TOP_BAND)
    )


def noise_flag(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return (c == -1).cast("int")


def iso_format(ts: Column | str) -> Column:
    return F.date_format(ts, ISO_LAYOUT)


def parse_iso_ts(text: Column | str) -> Column:
    """ISO-8601 text -> TIMESTAMP, null when it does not parse."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(c)


def alarm_text() -> Column:
    """One alarm line from a result row (score, window, counts)."""
    percent = F.bround(ratio("error_count", "log_count") * 100.0, 1)
    return F.format_string(
        ALARM_LAYOUT,
        F.bround("anomaly_score", 3), iso_format("window_start"), iso_format("window_end"),
        F.col("log_count"), F.col("error_count"), percent, F.col("critical_count"),
    )


def round_pct(col: Column) -> Column:
    """Two digits, ties to even."""
    return F.bround(col, 2)


def calendar_cols(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({
        "hour": F.hour(ts),
        "day_of_week": F.date_format(ts, "EEEE"),
        "date": F.to_date(ts),
    })
