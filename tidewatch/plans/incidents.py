"""Add labelled bursts to an existing log table, for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.windows import union_logs

# Fixed values per incident kind: label, seconds between logs (low, high), levels in order of preference, service.
INCIDENTS = {
    "spike": ("spike_error_spike", 0.1, 2.0, ["ERROR", "FATAL", "WARN"], None),
    "cascade": ("cascade_failure", 1.0, 5.0, ["ERROR", "FATAL"], None),
    "new_pattern": ("new_pattern", 0.0, 0.0, ["ERROR", "FATAL"], None),
    "security": ("security_breach", 0.5, 3.0, ["WARN", "ERROR"], "auth-service"),
}
SECURITY_TAIL = 5


def inject_incidents(logs: DataFrame, incidents: DataFrame, seed: int = 42) -> DataFrame:
    """Union ``logs`` with generated burst logs.

    ``incidents``: incident_id, timestamp, service, kind, size, and optionally
    category, which names the label of a spike.  A size of 0 adds no log.  Every burst row
    is derived from a hash of (incident, position, seed): repeatable, no state,
    and expanded on the executors.
    """
    rows = incidents.filter(F.col("size") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    draw = F.pmod(F.xxhash64("incident_id", "i", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    label = F.create_map(*[x for k, v in INCIDENTS.items() for x in (F.lit(k), F.lit(v[0]))])
    low = F.create_map(*[x for k, v in INCIDENTS.items() for x in (F.lit(k), F.lit(v[1]))])
    high = F.create_map(*[x for k, v in INCIDENTS.items() for x in (F.lit(k), F.lit(v[2]))])
    levels = F.create_map(*[x for k, v in INCIDENTS.items() for x in (F.lit(k), F.array(*[F.lit(lv) for lv in v[3]]))])
    kind, choices = F.col("kind"), F.element_at(levels, F.col("kind"))
    offset = F.col("i") * (F.element_at(low, kind) + draw * (F.element_at(high, kind) - F.element_at(low, kind)))
    picked = F.element_at(choices, (F.floor(draw * F.size(choices)) + 1).cast("int"))
    named = F.element_at(label, kind)
    if "category" in incidents.columns:
        named = F.when((kind == "spike") & F.col("category").isNotNull(), F.concat("category", F.lit("_spike"))).otherwise(named)
    burst = rows.select(
        F.timestamp_micros((F.unix_micros("timestamp") + offset * 1_000_000).cast("long")).alias("timestamp"),
        F.when(kind == "security", F.when(F.col("i") < F.col("size") - SECURITY_TAIL, "WARN").otherwise("ERROR"))
        .otherwise(picked).alias("level"),
        F.when(kind == "security", F.lit(INCIDENTS["security"][4])).otherwise(F.col("service")).alias("service"),
        F.concat(F.lit("Injected "), kind, F.lit(" incident "), F.col("incident_id").cast("string"),
                 F.lit(" attempt "), (F.col("i") + 1).cast("string")).alias("message"),
        F.lit(1).alias("is_anomaly"),
        named.alias("anomaly_type"),
    )
    return union_logs(logs, burst)
