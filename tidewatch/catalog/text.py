"""Queries over message text: tokens, tf-idf, text features per window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.catalog.base import LOGS, TEMPLATES, logs_of, query, volume_sql
from tidewatch.functions.scalar import nan_inf_to_zero
from tidewatch.functions.text import STOP_WORDS, first_flags, normalize_message, tokenize_ngrams
from tidewatch.operators import templates as T
from tidewatch.operators import textmodel as M
from tidewatch.operators import windows as W
from tidewatch.plans.features import all_features
from tidewatch.session import fresh_path, settle
from tidewatch.sources.logs import read_events

HB = "time_bucket(INTERVAL '1 hour', timestamp)"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDCLASS = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def grams_sql(source: str, text: str, keep: str) -> str:
    """CTEs tk (tokens) and gr (one row per uni- or bigram occurrence)."""
    return f""", tk AS (SELECT {keep}, list_filter(regexp_extract_all(lower({text}), '{WORDCLASS}{{2,}}'), lambda t: t NOT IN ({STOP})) AS t FROM {source}),
 gr AS (SELECT {keep}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk)"""


DOCS = r"""d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '\p{Nd}+', '<NUM>', 'g'), '/(?:[\p{L}\p{M}\p{Nd}\p{Pc}]|/)+', '<PATH>', 'g'),
  '^\s+|\s+$', '', 'g') AS template FROM documents)"""


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("tokenize_ngrams", f"WITH {DOCS}{grams_sql('d', 'template', 'doc_id')} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM gr GROUP BY 1")
def ngrams(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    # A row holds its document's tokens, so it can tell first occurrences; ids of several rows (none, as a rule) are counted by id.
    several = settle(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("doc_id").isNotNull()).select("doc_id"))
    tokens = tokenize_ngrams(normalize_message("text"))
    alone = docs.join(several, "doc_id", "left_anti").select("doc_id", F.inline(first_flags(tokens))).select(
        "term", F.lit(1).cast("long").alias("n"), (F.col("first") & F.col("doc_id").isNotNull()).cast("int").alias("docs"))
    shared = docs.join(several, "doc_id", "left_semi").select("doc_id", F.explode(tokens).alias("term")).groupBy("term", "doc_id").agg(
        F.count(F.lit(1)).alias("n")).select("term", "n", F.lit(1).alias("docs"))
    return alone.unionByName(shared).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


TFIDF = f""", c AS (SELECT template, count(*) AS c FROM d GROUP BY 1){grams_sql('c', 'template', 'template, c')},
 tf AS (SELECT template, c, term, count(*) AS tf FROM gr GROUP BY 1, 2, 3), n AS (SELECT sum(c) AS n FROM c),
 st AS (SELECT term, sum(c) AS df, sum(c * tf) AS total FROM tf GROUP BY 1),
 vo AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM st, n WHERE df >= 5 AND df <= 0.8 * n ORDER BY total DESC, term LIMIT 100),
 w AS (SELECT template, c, term, tf * idf AS w FROM tf JOIN vo USING (term))"""


def _doc_words(spark, sf):
    table = settle(M.word_table(T.template_counts(documents(spark, sf).withColumnRenamed("text", "message"))))
    n = table.agg(F.sum("count")).first()[0] or 0
    vocab = sorted(M.vocabulary(table, n).collect(), key=lambda r: r["term"])
    return table, n, [r["term"] for r in vocab], [r["idf"] for r in vocab]


@query("tfidf", f"WITH {DOCS}{TFIDF} SELECT md5(template) AS doc, c AS count, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY template)), 6) AS weight FROM w")
def tfidf(spark, sf):
    table, _, names, idf = _doc_words(spark, sf)
    return M.tfidf(table, names, idf)


def _svd(spark, sf):
    """Words of the documents, and model and variance share from their Gram matrix."""
    table, n, names, idf = _doc_words(spark, sf)
    gram, sums = M.gram_matrix(table, names, idf)
    basis = M.svd_basis(gram)
    share = M.svd_explained(gram, sums, n, basis) if n else 0.0
    none = spark.createDataFrame([], "template string, rarity double")
    return table, M.TextModel(names, idf, basis, np.zeros((1, basis.shape[1])), share, none)


@query("svd_project")
def svd_project(spark, sf):
    table, model = _svd(spark, sf)
    e = table.select("doc", M.embed_words(model, F.col("words"))["embedding"].alias("e"))
    return e.select("doc", *[F.col("e")[i].alias(f"tfidf_{i}") for i in range(model.basis.shape[1])])


@query("svd_explained")
def svd_explained(spark, sf):
    """Variance share kept, and the variances measured again on the projected rows."""
    table, model = _svd(spark, sf)
    rows = table.select("count", M.embed_words(model, F.col("words"))["embedding"].alias("e")).select("count", F.posexplode("e").alias("dim", "y"))
    mean = F.sum(F.col("count") * F.col("y")) / F.sum("count")
    return rows.groupBy("dim").agg((F.sum(F.col("count") * F.col("y") * F.col("y")) / F.sum("count") - mean * mean).alias("variance")).withColumn("explained", F.lit(model.explained))


# ---- text rows whose vectors come from the embeddings table (SQL-checkable) -------------------

TEXTROWS = f""", nv AS (SELECT count(*) AS n FROM embeddings), rar AS (SELECT template, 1.0 / count(*) AS message_rarity FROM tlogs GROUP BY 1),
 tr AS (SELECT l.event_id, l.timestamp, l.template, l.message, rar.message_rarity, ev.value AS message_distance, e.label AS message_cluster, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM tlogs l JOIN rar USING (template) JOIN events ev USING (event_id) JOIN embeddings e ON e.vec_id = l.event_id % (SELECT n FROM nv)),
 ts AS (SELECT *, (message_distance - min(message_distance) OVER ()) / (max(message_distance) OVER () - min(message_distance) OVER () + 1e-10) AS message_anomaly_score FROM tr)"""
TS = f"WITH {LOGS}{TEMPLATES}{TEXTROWS}"
VEC = 64  # components of the test vectors, all of them read
DIMS = [f"tfidf_{i}" for i in range(VEC)]


def text_rows(spark, sf):
    """Per-log text features by rule: vectors and clusters from ``embeddings``, distance from the event value."""
    logs = read_events(spark, sf, ["value"]).withColumnRenamed("value", "message_distance")
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = emb.agg(F.count(F.lit(1))).scalar()
    rows = T.rarity_lookup(logs, T.template_rarity(T.template_counts(logs))).withColumn("vec_id", F.col("event_id") % n)
    rows = rows.join(emb.select("vec_id", F.col("label").alias("message_cluster"), F.col("embedding").cast("array<double>").alias("vec")), "vec_id")
    ends = logs.agg(F.struct(F.min("message_distance").alias("lo"), F.max("message_distance").alias("hi"))).scalar()
    scored = M.message_score(rows, ends.getField("lo"), ends.getField("hi"))
    return scored.select("event_id", "timestamp", "template", "message", "message_rarity", "message_anomaly_score", "message_cluster",
                         *[F.col("vec")[i].alias(f"tfidf_{i}") for i in range(VEC)])


TMEANS = ", ".join(f"round(avg(vec[{i + 1}]), 6) AS tfidf_{i}" for i in range(VEC))


@query("text_window_means", f"{TS} SELECT {HB} AS timestamp, round(avg(message_rarity), 6) AS message_rarity, round(avg(message_anomaly_score), 6) AS message_anomaly_score, round(avg(message_cluster), 6) AS message_cluster, {TMEANS} FROM ts GROUP BY 1")
def text_window_means(spark, sf):
    cols = ["message_rarity", "message_anomaly_score", "message_cluster", *DIMS]
    return W.group_by_window(text_rows(spark, sf), [F.avg(c).alias(c) for c in cols], "1 hour")


@query("text_window_mode", f"""{TS}, m AS (SELECT {HB} AS timestamp, message_cluster, count(*) AS n FROM ts GROUP BY 1, 2)
 SELECT timestamp, CAST(arg_min(message_cluster, (-n, message_cluster)) AS INTEGER) AS message_cluster FROM m GROUP BY 1""")
def text_window_mode(spark, sf):
    return W.group_by_window(text_rows(spark, sf), [F.mode("message_cluster", True).alias("message_cluster")], "1 hour")


@query("tfidf_window_mean", f"{TS} SELECT {HB} AS timestamp, {TMEANS} FROM ts GROUP BY 1")
def tfidf_window_mean(spark, sf):
    return W.group_by_window(text_rows(spark, sf), [F.avg(c).alias(c) for c in DIMS], "1 hour")


@query("join_tfidf_window", f"{TS}, m AS (SELECT {HB} AS timestamp, round(avg(message_rarity), 6) AS message_rarity, {TMEANS} FROM ts GROUP BY 1) SELECT * FROM m")
def join_tfidf_window(spark, sf):
    rows = text_rows(spark, sf)
    return W.join_volume_text(W.group_by_window(rows, [F.avg("message_rarity").alias("message_rarity")], "1 hour"),
                              W.group_by_window(rows, [F.avg(c).alias(c) for c in DIMS], "1 hour"))


@query("hourly_text_metrics", f"""{TS}, f AS (SELECT template, min(timestamp) AS timestamp FROM ts GROUP BY 1), g AS (SELECT {HB} AS timestamp, count(*) AS n FROM f GROUP BY 1),
 m AS (SELECT {HB} AS timestamp, avg(message_anomaly_score) AS s, avg(message_rarity) AS r FROM ts GROUP BY 1)
 SELECT timestamp, coalesce(n, 0) AS new_templates, round(s, 6) AS avg_anomaly_score, round(r, 6) AS avg_rarity FROM m LEFT JOIN g USING (timestamp)""")
def hourly_text_metrics(spark, sf):
    return T.hourly_text_metrics(text_rows(spark, sf))


@query("top_anomalous_messages", f"{TS} SELECT event_id, message, round(message_anomaly_score, 6) AS message_anomaly_score FROM ts ORDER BY ts.message_anomaly_score DESC, event_id LIMIT 10")
def top_anomalous_messages(spark, sf):
    return T.top_anomalous_messages(text_rows(spark, sf).select("event_id", "message", "message_anomaly_score"))


@query("cluster_samples", f"""{TS} SELECT message_cluster, sample_no, event_id, message FROM (SELECT *, CAST(row_number() OVER (PARTITION BY message_cluster ORDER BY event_id) AS INTEGER) AS sample_no
 FROM ts WHERE message_cluster < 5) WHERE sample_no <= 3""")
def cluster_samples(spark, sf):
    return T.cluster_samples(text_rows(spark, sf)).select("message_cluster", "sample_no", "event_id", "message")


# ---- the whole feature vector ------------------------------------------------------------------

# A set model instead of a fitted one: fifteen terms, one dimension each, five centres.
TERMS = ["accepted", "amount", "cache", "code", "get", "key", "lookup", "num", "path", "payment", "served", "slow", "timeout", "upstream", "user_"]
IDF = [1.0 + 0.1 * i for i in range(15)]
CENTER_TERMS = ["cache", "payment", "served", "slow", "timeout"]


def set_model(logs) -> M.TextModel:
    centers = np.zeros((len(CENTER_TERMS), 15))
    for row, term in enumerate(CENTER_TERMS):
        centers[row, TERMS.index(term)] = 1.0
    return M.TextModel(TERMS, IDF, np.eye(15), centers, 1.0, settle(T.template_rarity(T.template_counts(logs))))


def all_features_sql(per_window: bool = False) -> str:
    raw = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) * {w:.1f} AS x{i}" for i, (t, w) in enumerate(zip(TERMS, IDF)))
    norm = "sqrt(" + " + ".join(f"x{i} * x{i}" for i in range(15)) + ")"
    y = ", ".join(f"x{i} / CASE WHEN {norm} > 0 THEN {norm} ELSE 1 END AS tfidf_{i}" for i in range(15))
    sq = " + ".join(f"tfidf_{i} * tfidf_{i}" for i in range(15))
    d2 = [f"({sq} - 2 * tfidf_{TERMS.index(t)} + 1)" for t in CENTER_TERMS]
    dist = ", ".join(d2)
    pick = f"list_position([{dist}], list_min([{dist}])) - 1"
    score = "(sum(n * distance) / sum(n) - min(distance)) / (max(distance) - min(distance) + 1e-10)" if per_window else "sum(n * score) / sum(n)"
    means = ", ".join(f"round(sum(n * tfidf_{i}) / sum(n), 6) AS tfidf_{i}" for i in range(15))
    return f"""WITH {LOGS}{TEMPLATES}{volume_sql('1 hour')}, cn AS (SELECT template, count(*) AS c FROM tlogs GROUP BY 1){grams_sql('cn', 'template', 'template, c')},
 x AS (SELECT template, c, {raw} FROM tk), y AS (SELECT template, c, {y} FROM x),
 z AS (SELECT *, CAST({pick} AS INTEGER) AS cluster, sqrt(greatest(list_min([{dist}]), 0)) AS distance FROM y),
 s AS (SELECT *, (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER () + 1e-10) AS score FROM z),
 wt AS (SELECT {HB} AS timestamp, template, count(*) AS n FROM tlogs GROUP BY 1, 2),
 tx AS (SELECT timestamp, round(sum(n / c) / sum(n), 6) AS message_rarity, round({score}, 6) AS message_anomaly_score, {means} FROM wt JOIN s USING (template) GROUP BY 1),
 mc AS (SELECT timestamp, cluster, sum(n) AS n FROM wt JOIN s USING (template) GROUP BY 1, 2),
 mo AS (SELECT timestamp, CAST(arg_min(cluster, (-n, cluster)) AS INTEGER) AS message_cluster FROM mc GROUP BY 1),
 gt AS (SELECT {HB} AS timestamp, max(is_anomaly) AS ground_truth FROM logs GROUP BY 1)
 SELECT {'*' if per_window else '* EXCLUDE (ground_truth)'} FROM vol JOIN tx USING (timestamp) JOIN mo USING (timestamp) JOIN gt USING (timestamp)"""


@query("all_features", all_features_sql())
def all_features_set(spark, sf):
    logs = logs_of(spark, sf)
    return all_features(logs, set_model(logs), "1 hour")


@query("all_features_fitted")
def all_features_fitted(spark, sf):
    """The same vector from a model fitted on the logs, saved and loaded again."""
    logs, path = logs_of(spark, sf), fresh_path(spark, "text-model")
    M.save_text_model(M.fit_text_model(logs), path)
    return all_features(logs, M.load_text_model(spark, path), "1 hour")
