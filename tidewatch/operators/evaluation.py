"""Metrics of binary flags against labels, and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import settle


def confusion_aggs(truth: str, pred: str) -> list[Column]:
    t, p = F.col(truth), F.col(pred)
    return [
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"),
    ]


def confusion_matrix(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_aggs(truth, pred)) if by else df.agg(*confusion_aggs(truth, pred))


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def add_metrics(counts: DataFrame, degenerate_zero: bool = False) -> DataFrame:
    """precision, recall, f1 from tn/fp/fn/tp; 0 where undefined.

    ``degenerate_zero`` also zeroes all three when nothing or everything is flagged.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    keep = ((tp + fp) > 0) & ((tn + fn) > 0) if degenerate_zero else F.lit(True)
    return counts.withColumns({
        "precision": F.when(keep, _safe(tp, tp + fp)).otherwise(F.lit(0.0)),
        "recall": F.when(keep, _safe(tp, tp + fn)).otherwise(F.lit(0.0)),
        "f1_score": F.when(keep, _safe(2 * tp, 2 * tp + fp + fn)).otherwise(F.lit(0.0)),
    })


def precision_recall_f1(df: DataFrame, truth: str, pred: str, degenerate_zero: bool = False) -> DataFrame:
    return add_metrics(confusion_matrix(df, truth, pred), degenerate_zero).select("precision", "recall", "f1_score")


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class precision/recall/f1/support, then accuracy, macro and weighted means."""
    cells = settle(df.agg(*confusion_aggs(truth, pred)))
    per_class = cells.select(F.explode(F.array(
        F.struct(F.lit("0").alias("class"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn")),
        F.struct(F.lit("1").alias("class"), "tp", "fp", "fn"))).alias("c")).select("c.*").withColumn("tn", F.lit(0))
    scored = add_metrics(per_class).select("class", "precision", "recall", "f1_score", (F.col("tp") + F.col("fn")).alias("support"))
    names = ["precision", "recall", "f1_score"]
    n = F.sum("support")
    macro = scored.agg(*[F.avg(c).alias(c) for c in names], n.alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = scored.agg(*[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in names], n.alias("support")).select(
        F.lit("weighted avg").alias("class"), *names, "support")
    accuracy = cells.select(
        F.lit("accuracy").alias("class"),
        *[((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias(c) for c in names],
        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("support"))
    return scored.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def model_comparison(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """One row per model (flag column), best F1 marked; all counts come from one pass."""
    aggs = []
    for i, pred in enumerate(models.values()):
        aggs.append(F.struct(*confusion_aggs(truth, pred)).alias(f"_m{i}"))
    wide = settle(df.agg(*aggs))
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_m{i}").alias("c"))
                     for i, name in enumerate(models)])
    counts = wide.select(F.explode(rows).alias("r")).select("r.model", "r.c.*")
    scored = add_metrics(counts).withColumn("predicted", F.col("tp") + F.col("fp"))
    best = scored.agg(F.max_by("model", F.struct("f1_score", F.col("model")))).scalar()
    return scored.withColumn("is_best", (F.col("model") == best).cast("int"))


def evaluate_results(results: DataFrame) -> DataFrame:
    return add_metrics(confusion_matrix(results, "ground_truth", "is_anomaly"))


def contamination_estimate(df: DataFrame, label: str = "is_anomaly", fallback: float = 0.01) -> DataFrame:
    mean = F.avg(label)
    usable = mean.isNotNull() & ~F.isnan(mean) & (mean > 0) & (mean <= 0.5)
    return df.agg(F.when(usable, mean).otherwise(F.lit(fallback)).alias("contamination"))


def top_configs(grid: DataFrame, params: Sequence[str], n: int = 5) -> DataFrame:
    """Best settings by F1; ties go to the earlier grid position."""
    return grid.orderBy(F.desc("f1_score"), *params).limit(n)


def best_config(grid: DataFrame, params: Sequence[str]) -> DataFrame:
    return top_configs(grid, params, 1)


def pivot_tuning(grid: DataFrame, rows: str, columns: str, values: Sequence, metrics: Sequence[str]) -> DataFrame:
    """Matrices of several metrics side by side (``{metric}_{value}``); given values save the pass that finds them."""
    wide = grid.groupBy(rows).pivot(columns, list(values)).agg(*[F.first(m).alias(m) for m in metrics])
    names = [f"{m}_{str(v).replace('.', '_')}" for v in values for m in metrics]
    return wide.toDF(rows, *(names if len(metrics) > 1 else [f"{metrics[0]}_{str(v).replace('.', '_')}" for v in values]))
