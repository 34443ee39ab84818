"""Tokens and the text model's tables against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import QUERIES
from tidewatch.functions.text import first_flags, normalize_message, tokenize_ngrams, words
from tidewatch.operators import textmodel as M
from tidewatch.session import settle


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    zipf = 1 / np.arange(1, 41)
    texts = [" ".join(f"w{chr(97 + w % 26)}{w // 26}" for w in rng.choice(40, rng.integers(0, 30), p=zipf / zipf.sum())) for _ in range(60)] + [None]
    return settle(spark.createDataFrame([(t, i % 4 + 1) for i, t in enumerate(texts)], "template string, count long"))


def counted(corpus):
    rows = corpus.select("count", tokenize_ngrams("template", ()).alias("t")).collect()
    df, total = Counter(), Counter()
    for r in rows:
        for term, n in Counter(r.t or []).items():
            df[term] += r["count"]
            total[term] += n * r["count"]
    return df, total, sum(r["count"] for r in rows)


def test_tokens_are_cut_once_per_row(spark):
    text = spark.range(1).select(F.lit("a bb cc").alias("m")).repartition(1).select(tokenize_ngrams("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1


def test_edges_are_trimmed_as_the_pattern_did(spark):
    rows = [f"{c}{d}a{c}b{d}{c}" for c in "\t\n\x0b\r\x1c\x85\xa0᠎ ​ 　﻿ x" for d in " \n"]
    df = spark.createDataFrame([(r,) for r in rows], "m string")
    assert df.filter(normalize_message("m") != F.regexp_replace(F.lower("m"), r"(?U)^\s+|\s+$", "")).count() == 0
    old = F.regexp_extract_all(F.lower("m"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    odd = spark.createDataFrame([("áb x ́ć _1 ‍ab cd‍ e² ①② d'ef",), ("",)], "m string")
    assert odd.filter(words("m", ()) != old).count() == 0


@pytest.mark.parametrize("size,min_df,max_df", [(10, 5, 0.8), (25, 1, 0.3), (5000, 5, 0.8), (12, 1, 1.0)])
def test_vocabulary_holds_the_most_frequent_terms(corpus, size, min_df, max_df):
    df, total, n = counted(corpus)
    want = sorted((t for t in df if min_df <= df[t] <= max_df * n), key=lambda t: (-total[t], t))[:size]
    got = M.vocabulary(settle(M.word_table(corpus, ())), n, size, min_df, max_df).collect()
    assert {r.term: r.df for r in got} == {t: df[t] for t in want}


def test_weights_come_from_the_row(corpus):
    terms, idf = ["wa0", "wa0 wb0", "wb0", "wc0 wa0"], [1.0, 2.0, 1.5, 3.0]
    table = settle(M.word_table(corpus, ()))
    found = M.tfidf(table, terms, idf)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc, r.term): r.weight for r in found.collect()}
    keys = corpus.select(M.doc_key().alias("doc"), tokenize_ngrams("template", ()).alias("t")).collect()
    want = {}
    for r in keys:
        tf = Counter(t for t in r.t or [] if t in terms)
        w = {t: n * idf[terms.index(t)] for t, n in tf.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        want.update({(r.doc, t): x / norm for t, x in w.items()})
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    assert M.tfidf(table, [], []).count() == 0


def test_first_flags(spark):
    rows = spark.range(1).select(F.inline(first_flags(F.array(*map(F.lit, ["b", "a", "b"]))))).collect()
    assert sorted(map(tuple, rows)) == [("a", True), ("b", False), ("b", True)]


def test_ids_of_several_rows_count_once(spark, tmp_path):
    spark.createDataFrame([(1, "red fox red fox"), (1, "red hen"), (2, "red"), (None, "red"), (None, "hen"), (3, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.term: (r.n, r.docs) for r in QUERIES["tokenize_ngrams"](spark, str(tmp_path)).collect()}
    assert got == {"red": (5, 2), "fox": (2, 1), "hen": (2, 1), "red fox": (2, 1), "fox red": (1, 1), "red hen": (1, 1)}
