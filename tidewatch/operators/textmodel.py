"""Text model: tf-idf terms, truncated SVD, k-means over message templates.

Everything textual depends on the template only, so fitting works on the table
of distinct templates weighted by their counts; logs are aggregated once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import STOP_WORDS, bind, first_flags, ngrams, tokenize_ngrams, words  # noqa: F401
from tidewatch.operators.lloyd import best_of
from tidewatch.operators.templates import template_counts, template_rarity
from tidewatch.schemas import TEXT_DIMS
from tidewatch.session import settle

# Vectorizer and cluster settings.
VOCABULARY, MIN_DF, MAX_DF = 100, 5, 0.8
CLUSTERS, SEED, RESTARTS = 20, 42, 10
EMBED = "struct<embedding: array<double>, cluster: int, distance: double>"


@dataclass
class TextModel:
    """Bounded by the vocabulary and k, except ``rarity`` which stays a table."""

    terms: list[str]
    idf: list[float]
    basis: np.ndarray            # vocabulary x dims
    centers: np.ndarray          # k x dims
    explained: float
    rarity: DataFrame            # template, rarity
    stop_words: tuple[str, ...] = field(default=STOP_WORDS)
    extremes: tuple[float, float] | None = None  # smallest and largest distance among the fitted templates


def doc_key(template: Column | str = "template") -> Column:
    """Fixed-width stand-in for a template, so exploded rows never carry whole texts."""
    return F.md5((F.col(template) if isinstance(template, str) else template).cast("binary"))


def word_table(counts: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """(doc, count, words): the words of each template, cut once; to be settled, as all later steps start from it."""
    return counts.select(doc_key().alias("doc"), "count", words("template", stop_words).alias("words"))


def vocabulary(table: DataFrame, n_docs: int, size: int = VOCABULARY, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """The ``size`` most frequent uni- and bigrams inside the document-frequency limits, with smoothed idf.

    Words are counted first.  A bigram occurs no more often than either of its
    words, and in no more documents; so only bigrams of words that are as
    frequent as the last word of a vocabulary of words alone have to be
    counted, and these are few.
    """
    def inside(stats):
        return stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))

    uni = table.select("count", F.inline(first_flags(F.col("words")))).groupBy("term").agg(
        F.sum(F.when(F.col("first"), F.col("count")).otherwise(F.lit(0))).alias("df"), F.sum("count").alias("total"))
    uni = settle(uni.filter(F.col("df") >= min_df))
    least = [r["total"] for r in inside(uni).orderBy(F.desc("total")).limit(size).select("total").collect()]
    often = settle(uni.filter(F.col("total") >= (least[-1] if len(least) == size else 0)).select("term"))
    pairs = table.select("doc", "count", F.inline(F.zip_with(
        "words", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    for side in ("a", "b"):
        pairs = pairs.join(often.withColumnRenamed("term", side), side, "left_semi")
    tf = pairs.groupBy("doc", "count", F.concat("a", F.lit(" "), "b").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    bi = tf.groupBy("term").agg(F.sum("count").alias("df"), F.sum(F.col("count") * F.col("tf")).alias("total"))
    kept = inside(uni.unionByName(bi)).orderBy(F.desc("total"), "term").limit(size)
    return kept.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def term_codes(found: Column, terms: list[str]) -> Column:
    """Positions in ``terms`` of the uni- and bigrams of a list of words that are in the vocabulary, repeats kept."""
    if not terms:
        return F.array().cast("array<int>")
    known = F.array(*[F.lit(t) for t in terms])
    return F.transform(F.filter(bind(found, ngrams), lambda t: t.isin(*terms)), lambda t: (F.array_position(known, t) - 1).cast("int"))


def tfidf(table: DataFrame, terms: list[str], idf: list[float]) -> DataFrame:
    """L2-normalised weights in long form (doc, count, term, weight).

    A document's counts come from its own row: nothing is shuffled.
    """
    if not terms:
        return table.select("doc", "count", F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    names, weights = F.array(*[F.lit(t) for t in terms]), F.array(*[F.lit(float(x)) for x in idf])

    def counted(codes):
        """Weight of each distinct code of a sorted list: its run's length times its idf."""
        def runs(own):
            at = F.transform(own, lambda c: F.array_position(codes, c))
            after = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(codes).cast("long") + 1))
            tf = F.zip_with(after, at, lambda x, y: x - y)
            return F.zip_with(own, F.slice(tf, F.lit(1), F.size(own)), lambda c, n: F.struct(c.alias("c"), (n * F.element_at(weights, c + 1)).alias("w")))

        return bind(F.array_distinct(codes), runs)

    raw = table.select("doc", "count", bind(F.sort_array(term_codes(F.col("words"), terms)), counted).alias("_w"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    rows = raw.select("doc", "count", norm.alias("_norm"), F.inline("_w"))
    return rows.select("doc", "count", F.element_at(names, F.col("c") + 1).alias("term"), (F.col("w") / F.col("_norm")).alias("weight"))


def _term_matrix(codes: pd.Series, idf: np.ndarray) -> np.ndarray:
    """L2-normalised tf-idf rows of a batch of term codes (rows x vocabulary)."""
    n, size = len(codes), len(idf)
    lists = [c if c is not None else () for c in codes]
    if not size or not any(map(len, lists)):
        return np.zeros((n, size))
    cells = np.repeat(np.arange(n) * size, [len(c) for c in lists]) + np.concatenate(lists).astype(np.int64)
    x = np.bincount(cells, minlength=n * size).reshape(n, size) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def gram_matrix(table: DataFrame, terms: list[str], idf: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, column sums) of the count-weighted term matrix.

    Tasks get term codes, never texts.  Each adds up its own V x V matrix; only
    those cells are shuffled and summed, so the driver receives V x V numbers
    whatever the corpus size.
    """
    weights, size = np.array(idf), len(terms)

    def partial(frames):
        gram, sums = np.zeros((size, size)), np.zeros(size)
        for pdf in frames:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at:at + 2048]
                x, c = _term_matrix(part["codes"], weights), part["count"].to_numpy(np.float64)
                gram += x.T @ (x * c[:, None])
                sums += c @ x
        i, j = np.nonzero(gram)
        yield pd.DataFrame({"i": i, "j": j, "g": gram[i, j]}).astype({"i": "int32", "j": "int32"})
        yield pd.DataFrame({"i": np.arange(size), "j": -1, "g": sums}).astype({"i": "int32", "j": "int32"})

    coded = table.select("count", term_codes(F.col("words"), terms).alias("codes"))
    cells = coded.mapInPandas(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    gram, sums = np.zeros((size, size)), np.zeros(size)
    for r in cells.collect():
        if r["j"] < 0:
            sums[r["i"]] = r["g"]
        else:
            gram[r["i"], r["j"]] = r["g"]
    return gram, sums


def svd_basis(gram: np.ndarray, dims: int = TEXT_DIMS) -> np.ndarray:
    """Leading right singular vectors (uncentred); each column's largest entry is positive."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    basis = vectors[:, np.argsort(values)[::-1][:dims]]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return np.pad(basis, ((0, 0), (0, dims - basis.shape[1])))


def svd_explained(gram: np.ndarray, sums: np.ndarray, n_docs: int, basis: np.ndarray) -> float:
    """Variance of the projected columns over the total column variance."""
    cov = gram / n_docs - np.outer(sums / n_docs, sums / n_docs)
    total = np.trace(cov)
    return float(np.trace(basis.T @ cov @ basis) / total) if total > 0 else 0.0


def embed(model: TextModel, template: Column | str = "template") -> Column:
    """struct(embedding, cluster, distance) of a template column."""
    return embed_words(model, words(F.col(template) if isinstance(template, str) else template, model.stop_words))


def embed_words(model: TextModel, found: Column) -> Column:
    """The same of the words of a template.

    Spark looks the terms up; a task function sees their codes, not the text.
    """
    idf, basis, centers = np.array(model.idf), model.basis, model.centers

    @F.pandas_udf(EMBED)
    def run(codes: pd.Series) -> pd.DataFrame:
        y = _term_matrix(codes, idf) @ basis
        d2 = ((y[:, None, :] - centers[None, :, :]) ** 2).sum(2)
        best = d2.argmin(1)
        dist = np.sqrt(d2[np.arange(len(y)), best])
        return pd.DataFrame({"embedding": list(y), "cluster": best.astype(np.int32), "distance": dist})

    return run(term_codes(found, model.terms))


def embed_rarely(model: TextModel, template: str = "template") -> Column:
    """``embed`` as a plain expression: slower, but where a conditional holds it back a row costs nothing and goes to no task function."""
    arrays = lambda m, kind: F.array(*[F.lit([float(x) for x in row]) for row in m]).cast(kind)
    weights, centers = F.lit([float(x) for x in model.idf]).cast("array<double>"), arrays(model.centers, "array<array<double>>")
    axes = arrays(model.basis[:len(model.idf)] * np.array(model.idf).reshape(-1, 1), "array<array<double>>")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def placed(codes: Column) -> Column:
        along = F.aggregate(codes, F.lit([0.0] * model.basis.shape[1]), lambda s, c: F.zip_with(s, F.element_at(axes, c + 1), lambda a, b: a + b))
        times = lambda c: F.size(F.filter(codes, lambda other: other == c))
        norm = F.sqrt(total(F.transform(F.array_distinct(codes), lambda c: F.pow(times(c) * F.element_at(weights, c + 1), F.lit(2.0)))))
        return bind(F.struct(along.alias("y"), F.when(norm > 0, norm).otherwise(F.lit(1.0)).alias("norm")),
                    lambda v: bind(F.transform(v["y"], lambda y: y / v["norm"]), nearest))

    def nearest(y: Column) -> Column:
        squares = F.transform(centers, lambda m: total(F.zip_with(y, m, lambda a, b: (a - b) * (a - b))))
        return bind(squares, lambda d2: F.struct(
            y.alias("embedding"), (F.array_position(d2, F.array_min(d2)) - 1).cast("int").alias("cluster"), F.sqrt(F.array_min(d2)).alias("distance")))

    codes = F.coalesce(term_codes(words(F.col(template), model.stop_words), model.terms), F.array().cast("array<int>"))
    return bind(codes, placed)


def kmeans_fit(points: DataFrame, k: int = CLUSTERS, seed: int = SEED, restarts: int = RESTARTS, vec: str = "vec", weight: str | None = None) -> np.ndarray:
    """Best of several seeded k-means runs (least cost), all run together; centres as a k x d matrix."""
    return best_of(points, k, seed, restarts, vec, weight)


def fit_text_model(logs: DataFrame, dims: int = TEXT_DIMS, k: int = CLUSTERS, size: int = VOCABULARY, min_df: int = MIN_DF,
                   max_df: float = MAX_DF, stop_words=STOP_WORDS, restarts: int = RESTARTS) -> TextModel:
    counts = settle(template_counts(logs))
    n_docs = counts.agg(F.sum("count")).first()[0] or 0
    table = settle(word_table(counts, stop_words))
    vocab = sorted(vocabulary(table, n_docs, size, min_df, max_df).collect(), key=lambda r: r["term"])
    names, idf = [r["term"] for r in vocab], [r["idf"] for r in vocab]
    gram, sums = gram_matrix(table, names, idf)
    basis = svd_basis(gram, dims)
    explained = svd_explained(gram, sums, n_docs, basis)
    model = TextModel(names, idf, basis, np.zeros((1, dims)), explained, template_rarity(counts), tuple(stop_words))
    placed = counts.withColumn("vec", embed(model)["embedding"])
    model.centers = kmeans_fit(placed, k, restarts=restarts, weight="count")
    return with_extremes(model, counts)


def with_extremes(model: TextModel, templates: DataFrame) -> TextModel:
    """The model with the distance scale of these templates, so that fitting, batches and streams score alike."""
    ends = templates.select(embed(model)["distance"].alias("d")).agg(F.min("d"), F.max("d")).first()
    return replace(model, extremes=(float(ends[0] or 0.0), float(ends[1] or 0.0)))


def template_features(templates: DataFrame, model: TextModel) -> DataFrame:
    """Per template: rarity (unseen 1.0), cluster, distance, tfidf_0..; one row each."""
    known = model.rarity.select("template", F.col("rarity").alias("message_rarity"))
    placed = templates.withColumn("_e", embed(model)).join(known, "template", "left")
    return placed.select(
        *templates.columns, F.coalesce("message_rarity", F.lit(1.0)).alias("message_rarity"),
        F.col("_e.cluster").alias("message_cluster"), F.col("_e.distance").alias("message_distance"),
        *[F.col("_e.embedding")[i].alias(f"tfidf_{i}") for i in range(model.basis.shape[1])])


def message_score(df: DataFrame, low: Column, high: Column, distance: str = "message_distance") -> DataFrame:
    """Min-max scaled distance."""
    return df.withColumn("message_anomaly_score", (F.col(distance) - low) / (high - low + F.lit(1e-10)))


def save_text_model(model: TextModel, path: str) -> None:
    spark = model.rarity.sparkSession
    model.rarity.write.mode("overwrite").parquet(f"{path}/rarity")
    body = {"terms": model.terms, "idf": model.idf, "basis": model.basis.tolist(), "centers": model.centers.tolist(),
            "explained": model.explained, "stop_words": list(model.stop_words), "extremes": model.extremes}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/text")


def load_text_model(spark: SparkSession, path: str) -> TextModel:
    body = json.loads(spark.read.text(f"{path}/text").first()[0])
    return TextModel(body["terms"], body["idf"], np.array(body["basis"]), np.array(body["centers"]), body["explained"],
                     spark.read.parquet(f"{path}/rarity"), tuple(body["stop_words"]), tuple(body["extremes"]) if body.get("extremes") else None)
