"""Corpus preparation in five stages, each over all that the one before it kept.

quality rules -> line deduplication -> near-duplicates -> mixing of sources -> tokens.  Every stage takes
(spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, linededup, mixing, quality, simhash
from tidewatch.llm.queries import vocabulary
from tidewatch.session import ensure_utc, settle, stage_scope

#: None: SQL has no 64-bit XXH64 and no vocabulary merges; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows a text that has changed."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    columns = docs.columns
    return quality.judge_quality(docs).filter("kept").select(*[F.col(f"`{c}`") for c in columns])


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out; every document stays."""
    return _with_length(linededup.dedup_passages(docs), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: three-word shingles, two or fewer differing bits of the fingerprint."""
    return simhash.drop_near_duplicates(docs, shingle=3, most=2)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in turn weigh 5, 2 and 1 and share 150 per cent of all words, none above twice its own."""
    return mixing.mix(docs, mixing.set_targets(mixing.cycle_weights(mixing.source_sizes(docs))))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests that hold them and their decoded text."""
    coded = bpe.encode(docs, vocabulary(), ["doc_id", "source"], decoded="_decoded")
    return coded.select(
        "doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"))


def _own_scratch(stage):
    """A stage's working tables go when the next stage begins: its result has been written by then."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_scope(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _own_scratch(quality_stage)),
    ("line_dedup", _own_scratch(lines_stage)),
    ("simhash_near_dedup", _own_scratch(near_stage)),
    ("source_mix", _own_scratch(mix_stage)),
    ("bpe_tokens", _own_scratch(tokens_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_utc(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
