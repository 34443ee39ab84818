"""Message templates: counts, rarity, novelty and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import normalize_message
from tidewatch.operators.windows import group_by_window
from tidewatch.schemas import RARE_ABOVE
from tidewatch.session import settle


def with_template(logs: DataFrame) -> DataFrame:
    return logs.withColumn("template", normalize_message("message"))


def template_counts(logs: DataFrame) -> DataFrame:
    """Frequency per template; a hot template is summed on the map side."""
    return with_template(logs).groupBy("template").agg(F.count(F.lit(1)).alias("count"))


def template_rarity(counts: DataFrame) -> DataFrame:
    return counts.select("template", (F.lit(1.0) / F.col("count")).alias("rarity"))


def top_templates(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("count"), "template").limit(n)


def rarity_lookup(logs: DataFrame, rarity: DataFrame) -> DataFrame:
    """Attach the trained rarity; templates never seen in training get 1.0.

    No broadcast hint: AQE broadcasts the lookup once its measured size allows,
    and otherwise splits the skewed side of the sort-merge join.
    """
    return (
        with_template(logs).join(rarity.select("template", F.col("rarity").alias("message_rarity")), "template", "left")
        .withColumn("message_rarity", F.coalesce("message_rarity", F.lit(1.0)))
    )


def count_rare(scored: DataFrame, threshold: float = RARE_ABOVE) -> DataFrame:
    return scored.agg(F.count_if(F.col("message_rarity") > threshold).alias("rare_logs"), F.count(F.lit(1)).alias("total_logs"))


def first_seen_template(logs: DataFrame, tie: str = "event_id") -> DataFrame:
    """The first log of each template in time order.

    The rank limit is applied inside every map task before the shuffle, so at
    most one row per task and template moves.
    """
    rank = F.row_number().over(Window.partitionBy("template").orderBy("timestamp", tie))
    return with_template(logs).withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def new_templates_per_hour(logs: DataFrame) -> DataFrame:
    first = with_template(logs).groupBy("template").agg(F.min("timestamp").alias("timestamp"))
    return group_by_window(first, [F.count(F.lit(1)).alias("new_templates")], "1 hour")


def hourly_text_metrics(scored: DataFrame) -> DataFrame:
    """Per hour: new templates, mean message score, mean rarity.

    ``scored`` has timestamp, template, message_anomaly_score, message_rarity.
    Logs are reduced once to (hour, template) sums; both the means and the first
    sightings come from that table.
    """
    per = settle(group_by_window(scored, [
        F.count(F.lit(1)).alias("n"), F.sum("message_anomaly_score").alias("score"), F.sum("message_rarity").alias("rarity"),
        F.min("timestamp").alias("first")], "1 hour", keys=["template"]))
    means = per.groupBy("timestamp").agg(
        (F.sum("score") / F.sum("n")).alias("avg_anomaly_score"), (F.sum("rarity") / F.sum("n")).alias("avg_rarity"))
    first = per.groupBy("template").agg(F.min("first").alias("timestamp"))
    fresh = group_by_window(first, [F.count(F.lit(1)).alias("new_templates")], "1 hour")
    return (
        means.join(fresh, "timestamp", "left").withColumn("new_templates", F.coalesce("new_templates", F.lit(0)))
        .select("timestamp", "new_templates", "avg_anomaly_score", "avg_rarity")
    )


def template_drift(logs: DataFrame, period: str = "1 day", rare_share: float = 0.01, spike_factor: float = 3.0) -> DataFrame:
    """Compare each template with the period before: new, vanished, or a rare one spiking.

    ``new``: never seen before this period.  ``vanished``: present in the last
    period, absent in this one.  ``spike``: rare in the last period (share of
    logs below ``rare_share``) and at least ``spike_factor`` times as frequent now.
    """
    per = settle(group_by_window(with_template(logs), [F.count(F.lit(1)).alias("n")], period, keys=["template"]))
    totals = per.groupBy("timestamp").agg(F.sum("n").alias("total"))
    births = per.groupBy("template").agg(F.min("timestamp").alias("born"))
    bounds = totals.agg(F.max("timestamp")).scalar()
    now = per.join(births, "template").select("timestamp", "template", "n", "born")
    last = (
        per.join(totals, "timestamp")
        .select((F.col("timestamp") + F.expr(f"INTERVAL {period}")).alias("timestamp"), "template",
                F.col("n").alias("n_before"), (F.col("n") / F.col("total")).alias("share_before"))
        .filter(F.col("timestamp") <= bounds)
    )
    kind = (
        F.when(F.col("n").isNull(), "vanished")
        .when(F.col("born") == F.col("timestamp"), "new")
        .when((F.col("share_before") < rare_share) & (F.col("n") >= spike_factor * F.col("n_before")), "spike")
    )
    return (
        now.join(last, ["timestamp", "template"], "full").withColumn("drift", kind).filter(F.col("drift").isNotNull())
        .select("timestamp", "template", "drift", F.coalesce("n", F.lit(0)).alias("n"),
                F.coalesce("n_before", F.lit(0)).alias("n_before"))
    )


def top_anomalous_messages(scored: DataFrame, n: int = 10, score: str = "message_anomaly_score", tie: str = "event_id") -> DataFrame:
    return scored.orderBy(F.desc(score), tie).limit(n)


def cluster_sizes(df: DataFrame, label: str = "message_cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def cluster_samples(df: DataFrame, label: str = "message_cluster", clusters: int = 5, n: int = 3, order: str = "event_id") -> DataFrame:
    """First ``n`` rows of each of the first ``clusters`` clusters (rank limit before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.filter(F.col(label) < clusters).withColumn("sample_no", rank).filter(F.col("sample_no") <= n)
