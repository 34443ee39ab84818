"""The 30 features per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import nan_inf_to_zero
from tidewatch.operators.templates import with_template
from tidewatch.operators.textmodel import TextModel, message_score, template_features
from tidewatch.operators.windows import count_aggs, gap_fill, group_by_window, window_rates
from tidewatch.schemas import COUNT_COLS, TEXT_DIMS, VOLUME_COLS, WINDOW_WIDTH
from tidewatch.session import settle


def mean_over(cols: list[str], weight: str = "_n") -> list:
    """Weighted means: pre-counted rows stand for all their logs."""
    total = F.sum(weight)
    return [(F.sum(F.col(c) * F.col(weight)) / total).alias(c) for c in cols]


def weighted_mode(col: str, groups: int, weight: str = "_n"):
    """Most frequent of 0..groups-1, smallest on ties, -1 when empty; sums only, so it combines on the map side."""
    tallies = F.array(*[F.coalesce(F.sum(F.when(F.col(col) == i, F.col(weight))), F.lit(0)) for i in range(groups)])
    best = F.array_max(tallies)
    return F.when(best > 0, F.array_position(tallies, best).cast("int") - 1).otherwise(F.lit(-1))


def per_template(logs: DataFrame, width: str) -> DataFrame:
    """Level counts per (window, template): the only pass over the raw logs."""
    return group_by_window(with_template(logs), [*count_aggs(), F.count(F.lit(1)).alias("_n")], width, keys=["template"])


def with_text_features(counted: DataFrame, model: TextModel, extremes: tuple[float, float] | None = None) -> DataFrame:
    """(window, template) counts with the template's features attached, message score included.

    Template features are settled: they are read for the extremes and for the
    join, and must not be evaluated again over anything larger.
    """
    found = settle(template_features(counted.select("template").distinct(), model))
    extremes = extremes or model.extremes
    if extremes is None:
        ends = found.agg(F.min("message_distance").alias("lo"), F.max("message_distance").alias("hi")).first()
        extremes = (ends["lo"] or 0.0, ends["hi"] or 0.0)
    low, high = (F.lit(float(x)) for x in extremes)
    return counted.join(message_score(found, low, high), "template")


def all_features(logs: DataFrame, model: TextModel, width: str = WINDOW_WIDTH, cluster: str = "mode", fill_gaps: bool = False,
                 extremes: tuple[float, float] | None = None) -> DataFrame:
    """Volume and text features in one aggregation per window, NaN and infinities as 0.

    Logs are scanned once and counted per (window, template), a table that is
    kept; template features are computed once per distinct template and joined
    to those counts.  A hot
    template or window is therefore combined before anything is shuffled.
    """
    joined = with_text_features(settle(per_template(logs, width)), model, extremes)
    dims = [f"tfidf_{i}" for i in range(model.basis.shape[1])]
    group = (
        weighted_mode("message_cluster", len(model.centers)).alias("message_cluster") if cluster == "mode"
        else mean_over(["message_cluster"])[0])
    windows = joined.groupBy("timestamp").agg(
        *[F.sum(c).alias(c) for c in COUNT_COLS], *mean_over(["message_rarity", "message_anomaly_score"]), group, *mean_over(dims))
    if fill_gaps:
        fills = {c: 0 for c in windows.columns if c != "timestamp"}
        windows = gap_fill(windows, width, fills={**fills, "message_cluster": -1 if cluster == "mode" else 0})
    out = window_rates(windows).select("timestamp", *VOLUME_COLS, "message_rarity", "message_anomaly_score", "message_cluster", *dims)
    return nan_inf_to_zero(out)
