"""Queries over vectors: scaling, clustering, scores, forests, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import LOGS, logs_of, query, volume_sql
from tidewatch.functions.scalar import noise_flag
from tidewatch.functions.vector import assemble, center_matrix, nearest_center
from tidewatch.operators import coreindex as C
from tidewatch.operators import dbscan as D
from tidewatch.operators import evaluation as E
from tidewatch.operators import hdbscan as H
from tidewatch.operators import scoring as S
from tidewatch.operators import templates as T
from tidewatch.operators.forest import isolation_forest
from tidewatch.operators.silhouette import silhouette, silhouette_values
from tidewatch.operators.textmodel import kmeans_fit, message_score
from tidewatch.operators.windows import volume_features
from tidewatch.plans import detect as P
from tidewatch.plans import tuning
from tidewatch.schemas import VOLUME_COLS
from tidewatch.session import fresh_path, settle

DIMS, EPS, NEED = 64, 1.15, 4
V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def dbscan_sql(eps: float, need: int, source: str = "v", tag: str = "") -> str:
    """CTEs ending in lab{tag}(id, label): textbook density clustering, numbered by smallest core id."""
    return f""", pr{tag} AS (SELECT a.id AS i, b.id AS j FROM {source} a JOIN {source} b ON list_distance(a.vec, b.vec) <= {eps}),
 co{tag} AS (SELECT i FROM pr{tag} GROUP BY i HAVING count(*) >= {need}),
 ed{tag} AS (SELECT p.i, p.j FROM pr{tag} p JOIN co{tag} x ON p.i = x.i JOIN co{tag} y ON p.j = y.i WHERE p.i <> p.j),
 cc{tag}(id, comp) USING KEY (id) AS (SELECT i AS id, i AS comp FROM co{tag} UNION
   (SELECT e.i AS id, min(c.comp) AS comp FROM cc{tag} c JOIN ed{tag} e ON c.id = e.j JOIN recurring.cc{tag} u ON u.id = e.i
    WHERE c.comp < u.comp GROUP BY e.i)),
 nu{tag} AS (SELECT id, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS label FROM cc{tag}),
 lab{tag} AS (SELECT s.id, coalesce(n.label, b.label, -1) AS label FROM {source} s LEFT JOIN nu{tag} n USING (id)
   LEFT JOIN (SELECT p.i AS id, min(n.label) AS label FROM pr{tag} p JOIN nu{tag} n ON p.j = n.id GROUP BY 1) b ON b.id = s.id)"""


VR = f"WITH RECURSIVE {V}"


@query("standard_scale", f"WITH {LOGS}{volume_sql('1 hour', digits=None)} SELECT timestamp, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}" for c in VOLUME_COLS) + " FROM vol")
def standard_scale(spark, sf):
    return S.standard_scale(volume_features(logs_of(spark, sf), "1 hour"), VOLUME_COLS)


@query("eps_neighbors", f"WITH {V} SELECT a.id, count(*) AS n_neighbors FROM v a JOIN v b ON list_distance(a.vec, b.vec) <= {EPS} GROUP BY 1")
def eps_neighbors(spark, sf):
    return D.eps_neighbors(vectors(spark, sf), EPS, "id", "vec")


@query("dbscan_fit", f"{VR}{dbscan_sql(EPS, NEED)} SELECT id, label FROM lab")
def dbscan_fit(spark, sf):
    return D.dbscan_fit(vectors(spark, sf), EPS, NEED, "id", "vec")


@query("noise_flag", f"{VR}{dbscan_sql(EPS, NEED)} SELECT id, CAST(label = -1 AS INTEGER) AS is_anomaly FROM lab")
def flags(spark, sf):
    return D.dbscan_fit(vectors(spark, sf), EPS, NEED, "id", "vec").select("id", noise_flag("label").alias("is_anomaly"))


@query("cluster_noise_stats", f"{VR}{dbscan_sql(EPS, NEED)} SELECT count(DISTINCT label) FILTER (label <> -1) AS n_clusters, count(*) FILTER (label = -1) AS n_noise, round(count(*) FILTER (label = -1) * 100.0 / count(*), 6) AS noise_pct FROM lab")
def cluster_noise_stats(spark, sf):
    return S.cluster_noise_stats(D.dbscan_fit(vectors(spark, sf), EPS, NEED, "id", "vec"))


@query("cluster_sizes", f"{VR}{dbscan_sql(EPS, NEED)} SELECT label, count(*) AS size FROM lab GROUP BY 1")
def cluster_sizes(spark, sf):
    return T.cluster_sizes(D.dbscan_fit(vectors(spark, sf), EPS, NEED, "id", "vec"), "label")


@query("dbscan_assign", f"""{VR}{dbscan_sql(EPS, NEED)}, w AS (SELECT id, list_transform(vec, lambda x: x * 1.02) AS vec FROM v),
 k AS (SELECT v.vec, lab.label FROM v JOIN co ON v.id = co.i JOIN lab ON lab.id = v.id)
 SELECT w.id, coalesce(min(k.label), -1) AS label FROM w LEFT JOIN k ON list_distance(w.vec, k.vec) <= {EPS} GROUP BY 1""")
def dbscan_assign(spark, sf):
    """All vectors, slightly stretched, against the core rows fitted on all vectors."""
    v = vectors(spark, sf)
    cores = D.core_points(D.dbscan_model(v, EPS, NEED, "id", "vec"))
    return C.dbscan_assign(v.withColumn("vec", F.transform("vec", lambda x: x * F.lit(1.02))), cores, EPS, "id", "vec")


# The same over small blocks, so that the box tree, decided nodes and tiles all take part at this size.
SMALL = 32


@query("eps_neighbors_blocks", f"WITH {V} SELECT a.id, count(*) AS n_neighbors FROM v a JOIN v b ON list_distance(a.vec, b.vec) <= {EPS} GROUP BY 1")
def eps_neighbors_blocks(spark, sf):
    return D.eps_neighbors(vectors(spark, sf), EPS, "id", "vec", SMALL)


@query("dbscan_fit_blocks", f"{VR}{dbscan_sql(1.2, 8)} SELECT id, label FROM lab")
def dbscan_fit_blocks(spark, sf):
    return D.dbscan_fit(vectors(spark, sf), 1.2, 8, "id", "vec", block_rows=SMALL)


@query("dbscan_assign_index", f"""{VR}{dbscan_sql(EPS, NEED)}, w AS (SELECT id, list_transform(vec, lambda x: x * 0.98) AS vec FROM v),
 k AS (SELECT v.vec, lab.label FROM v JOIN co ON v.id = co.i JOIN lab ON lab.id = v.id)
 SELECT w.id, coalesce(min(k.label), -1) AS label FROM w LEFT JOIN k ON list_distance(w.vec, k.vec) <= {EPS} GROUP BY 1""")
def dbscan_assign_index(spark, sf):
    """Core rows stored as a block index, opened again and probed by all vectors, slightly shrunk."""
    v = vectors(spark, sf)
    index = C.build_core_index(D.core_points(D.dbscan_model(v, EPS, NEED, "id", "vec")), block_rows=SMALL)
    return C.probe_cores(v.withColumn("vec", F.transform("vec", lambda x: x * F.lit(0.98))), C.open_core_index(spark, index.path), EPS, "id", "vec")


CENTERS = """, cd AS (SELECT label, i, avg(x) AS x FROM (SELECT {l} AS label, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM {s}) GROUP BY 1, 2),
 ce AS (SELECT label, list(x ORDER BY i) AS center FROM cd GROUP BY 1)"""
BY_LABEL = CENTERS.format(l="label", s="v")
NEAR = """, nd AS (SELECT v.id, ce.label, list_distance(v.vec, ce.center) AS d FROM v, ce),
 ne AS (SELECT id, arg_min(label, (d, label)) AS centroid, min(d) AS d FROM nd GROUP BY 1)"""


def _label_centers(v):
    return S.cluster_centers(v, DIMS, "label", "vec")


def _near(spark, sf):
    v = vectors(spark, sf)
    names, mat = center_matrix(_label_centers(v))
    return v.withColumn("near", nearest_center("vec", names, mat))


@query("cluster_centers", f"WITH {V}{BY_LABEL} SELECT label, CAST(i AS INTEGER) AS dim, round(x, 6) AS x FROM cd")
def cluster_centers(spark, sf):
    return _label_centers(vectors(spark, sf)).select("label", F.posexplode("center").alias("p", "x")).select("label", (F.col("p") + 1).alias("dim"), "x")


@query("nearest_centroid", f"WITH {V}{BY_LABEL}{NEAR} SELECT id, centroid, round(d, 6) AS distance FROM ne")
def nearest_centroid(spark, sf):
    return _near(spark, sf).select("id", F.col("near.label").alias("centroid"), F.col("near.distance").alias("distance"))


@query("kmeans_assign", f"WITH {V}{BY_LABEL}{NEAR} SELECT centroid, count(*) AS n FROM ne GROUP BY 1")
def kmeans_assign(spark, sf):
    return _near(spark, sf).groupBy(F.col("near.label").alias("centroid")).agg(F.count(F.lit(1)).alias("n"))


@query("centroid_distance", f"WITH {V}{BY_LABEL} SELECT v.id, round(list_distance(v.vec, ce.center), 6) AS distance FROM v JOIN ce USING (label)")
def centroid_distance(spark, sf):
    v = vectors(spark, sf)
    from tidewatch.functions.vector import distance

    return v.join(_label_centers(v), "label").select("id", distance(F.col("vec"), F.col("center")).alias("distance"))


@query("message_score", f"WITH {V}{BY_LABEL}{NEAR} SELECT id, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER () + 1e-10), 6) AS score FROM ne")
def score(spark, sf):
    near = settle(_near(spark, sf).select("id", F.col("near.distance").alias("message_distance")))
    ends = near.agg(F.struct(F.min("message_distance").alias("lo"), F.max("message_distance").alias("hi"))).scalar()
    return message_score(near, ends.getField("lo"), ends.getField("hi")).select("id", F.col("message_anomaly_score").alias("score"))


@query("silhouette", f"""WITH {V}, p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.vec, b.vec)) AS d, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3),
 q AS (SELECT id, max(d / n) FILTER (label = other) AS a, min(d / n) FILTER (label <> other) AS b FROM p GROUP BY 1)
 SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS rows FROM q""")
def silhouette_query(spark, sf):
    return silhouette(vectors(spark, sf), "id", "vec", "label")


@query("silhouette_blocks", f"""WITH {V}, p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.vec, b.vec)) AS d, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3),
 q AS (SELECT id, label, max(d / n) FILTER (label = other) AS a, min(d / n) FILTER (label <> other) AS b FROM p GROUP BY 1, 2)
 SELECT id, label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM q""")
def silhouette_blocks(spark, sf):
    """Each row's own value, over small blocks."""
    return silhouette_values(vectors(spark, sf), "id", "vec", "label", block_rows=SMALL)


SCORED = CENTERS.format(l="label", s="(SELECT v.vec, lab.label FROM v JOIN lab USING (id) WHERE lab.label <> -1)") + """,
 dd AS (SELECT lab.id, lab.label, ce.label AS cl, list_distance(v.vec, ce.center) AS d FROM lab JOIN v USING (id), ce),
 rw AS (SELECT id, label, CASE WHEN label = -1 THEN min(d) ELSE min(d) FILTER (cl = label) END AS raw FROM dd GROUP BY 1, 2)"""


@query("anomaly_score", f"{VR}{dbscan_sql(EPS, NEED)}{SCORED} SELECT id, label, round(raw / max(raw) OVER (), 6) AS anomaly_score FROM rw")
def anomaly_score(spark, sf):
    v = vectors(spark, sf).drop("label")
    rows = v.join(D.dbscan_fit(v, EPS, NEED, "id", "vec"), "id")
    return S.anomaly_score(settle(rows), DIMS).select("id", "label", "anomaly_score")


@query("predict_with_confidence", f"{VR}{dbscan_sql(EPS, NEED)}{SCORED} SELECT id, CAST(label = -1 AS INTEGER) AS is_anomaly, round(raw / max(raw) OVER (), 6) AS anomaly_score, label AS cluster_label FROM rw")
def predict_with_confidence(spark, sf):
    v = vectors(spark, sf).drop("label")
    rows = v.join(D.dbscan_fit(v, EPS, NEED, "id", "vec"), "id")
    return S.predict_with_confidence(settle(rows), DIMS).select("id", "is_anomaly", "anomaly_score", "cluster_label")


# ---- detection on windows --------------------------------------------------------------------

WEPS, WNEED = 1.37, 5
WINDOWS = f"""{volume_sql('1 hour', digits=None)}, v AS (SELECT epoch_us(timestamp) AS id, [""" + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END" for c in VOLUME_COLS) + "] AS vec FROM vol)"


@query("detect_batch", f"WITH RECURSIVE {LOGS}{WINDOWS}{dbscan_sql(WEPS, WNEED)}{SCORED.replace('65', str(len(VOLUME_COLS) + 1))} "
       "SELECT make_timestamp(id) AS timestamp, CAST(label = -1 AS INTEGER) AS is_anomaly, round(raw / max(raw) OVER (), 6) AS anomaly_score, label AS cluster_label FROM rw")
def detect_batch(spark, sf):
    return P.detect_batch(logs_of(spark, sf), "1 hour", WEPS, WNEED)


@query("snk_model_save", f"WITH RECURSIVE {LOGS}{WINDOWS}{dbscan_sql(WEPS, WNEED)}{SCORED.replace('65', str(len(VOLUME_COLS) + 1))}, "
       "o AS (SELECT make_timestamp(id) AS timestamp, round(raw / max(raw) OVER (), 6) AS s, label FROM rw) "
       "SELECT timestamp, s AS before, label AS before_label, s AS after, label AS after_label FROM o")
def model_round_trip(spark, sf):
    """Scores of a saved and reloaded detector next to those of the one in memory."""
    logs, path = logs_of(spark, sf), fresh_path(spark, "detector")
    model = P.fit_detector(logs, "1 hour", WEPS, WNEED)
    P.save_detector(model, path)
    again = P.load_detector(spark, path)
    features = settle(P.features_for(logs, None, "1 hour"))
    pick = lambda m, name: P.score_windows(features, m).select("timestamp", F.col("anomaly_score").alias(name), F.col("cluster_label").alias(f"{name}_label"))
    return pick(model, "before").join(pick(again, "after"), "timestamp")


@query("src_model_load", f"WITH RECURSIVE {LOGS}{WINDOWS}{dbscan_sql(WEPS, WNEED)}{SCORED.replace('65', str(len(VOLUME_COLS) + 1))} "
       "SELECT make_timestamp(id) AS timestamp, CAST(label = -1 AS INTEGER) AS is_anomaly, round(raw / max(raw) OVER (), 6) AS anomaly_score, label AS cluster_label FROM rw")
def model_loaded(spark, sf):
    """Windows scored by a detector read back from storage."""
    logs, path = logs_of(spark, sf), fresh_path(spark, "detector")
    P.save_detector(P.fit_detector(logs, "1 hour", WEPS, WNEED), path)
    return P.score_windows(P.features_for(logs, None, "1 hour"), P.load_detector(spark, path))


# ---- fitted at random, repeatable; no SQL counterpart ------------------------------------------

@query("isolation_forest")
def forest(spark, sf):
    rows = assemble(volume_features(logs_of(spark, sf), "1 hour"), VOLUME_COLS).select(F.unix_micros("timestamp").alias("id"), "vec")
    return isolation_forest(rows, "id", "vec", 0.02)


@query("kmeans_fit")
def kmeans(spark, sf):
    centers = kmeans_fit(vectors(spark, sf), k=10)
    return _near_fixed(vectors(spark, sf), centers)


def _near_fixed(v, centers):
    return v.withColumn("n", nearest_center("vec", range(len(centers)), centers)).groupBy(F.col("n.label").alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.avg("n.distance").alias("avg_distance"))


@query("hdbscan_core_distance", f"""WITH {V}, d AS (SELECT a.id, list_distance(a.vec, b.vec) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec)) AS k
 FROM v a JOIN v b ON a.id <> b.id) SELECT id, round(d, 6) AS core_distance FROM d WHERE k = 5""")
def hdbscan_core_distance(spark, sf):
    return H.core_distance(vectors(spark, sf), 5, "id", "vec")


@query("hdbscan")
def hdbscan(spark, sf):
    return H.hdbscan(vectors(spark, sf), 5, 3, "id", "vec")


@query("tune_hdbscan")
def tune_hdbscan(spark, sf):
    v = vectors(spark, sf).withColumn("truth", F.col("label") == 0).drop("label")
    return tuning.tune_hdbscan(v, "id", "vec", "truth", [5, 10], [3])


# ---- tuning ----------------------------------------------------------------------------------

TEPS, TMIN = [1.1, 1.15, 1.2], [4, 8]


def _tune_sql() -> str:
    parts, rows = "", []
    for i, (e, m) in enumerate((e, m) for e in TEPS for m in TMIN):
        parts += dbscan_sql(e, m, tag=str(i))
        rows.append(f"SELECT CAST({e} AS DOUBLE) AS eps, {m} AS min_samples, lab{i}.label, (v.label = 0) AS truth FROM lab{i} JOIN v USING (id)")
    return f"""{VR}{parts}, al AS ({' UNION ALL '.join(rows)}),
 g AS (SELECT eps, min_samples, CAST(count(DISTINCT label) FILTER (label <> -1) AS INTEGER) AS n_clusters, count(*) FILTER (label = -1) AS n_noise, count(*) AS n,
   count(*) FILTER (label = -1 AND truth) AS tp, count(*) FILTER (label = -1 AND NOT truth) AS fp, count(*) FILTER (label <> -1 AND truth) AS fn FROM al GROUP BY 1, 2),
 grid AS (SELECT eps, min_samples, n_clusters, n_noise, round(n_noise * 100.0 / n, 6) AS noise_pct,
   round(CASE WHEN n_noise IN (0, n) THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN n_noise IN (0, n) THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
   round(CASE WHEN n_noise IN (0, n) THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1_score FROM g)"""


def _grid(spark, sf):
    v = vectors(spark, sf).withColumn("truth", F.col("label") == 0).drop("label")
    return settle(tuning.tune_dbscan(v, "id", "vec", "truth", TEPS, TMIN))


@query("tune_grid", _tune_sql() + " SELECT * FROM grid")
def tune_grid(spark, sf):
    return _grid(spark, sf)


@query("top_configs", _tune_sql() + " SELECT * FROM grid ORDER BY f1_score DESC, eps, min_samples LIMIT 5")
def top_configs(spark, sf):
    return E.top_configs(_grid(spark, sf), ["eps", "min_samples"])


@query("best_config", _tune_sql() + " SELECT * FROM grid ORDER BY f1_score DESC, eps, min_samples LIMIT 1")
def best_config(spark, sf):
    return E.best_config(_grid(spark, sf), ["eps", "min_samples"])


HEAT = ["f1_score", "precision", "recall", "noise_pct"]


@query("pivot_tuning", _tune_sql() + " SELECT min_samples, " + ", ".join(
    f"max({m}) FILTER (eps = {e}) AS {m}_{str(e).replace('.', '_')}" for e in TEPS for m in HEAT) + " FROM grid GROUP BY 1")
def pivot_tuning(spark, sf):
    return E.pivot_tuning(_grid(spark, sf), "min_samples", "eps", TEPS, HEAT)


@query("tune_forest")
def tune_forest(spark, sf):
    v = vectors(spark, sf).withColumn("truth", F.col("label") == 0).drop("label")
    return tuning.tune_forest(v, "id", "vec", "truth")
