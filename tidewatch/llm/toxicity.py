"""Toxicity: a linear classifier learnt from confirmed toxic examples and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import settle

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)  # beginnings of longer words count as features, so inflected forms meet
#: Bounds of what is fitted on; the counts behind the vocabulary cover all rows that may be learnt from.
MOST_POSITIVE, MOST_UNLABELLED = 10_000, 20_000
MOST_FEATURES = 2_048
#: Bits that tell a counting task which features may matter; with more features than bits more is counted, nothing is lost.
SLOTS = 1 << 24
LEAST_DOCS, LEAST_LIFT, LEAST_DEVIANCE = 4, 3.0, 30.0
FLUSH = 200_000
STEPS, RATE, DECAY = 400, 0.05, 1e-3


def features(text: str) -> set[str]:
    """Distinct words of a whole text in lower case, and the beginnings of longer ones (marked by ^)."""
    found = set(WORD.findall(text.lower()))
    return found | {f"^{w[:n]}" for w in found for n in PREFIXES if len(w) > n}


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 0 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_slots(counted: DataFrame) -> np.ndarray:
    """A bit for each slot that a feature of ``counted`` falls into: 2 MB, whatever the number of features."""
    slot = F.pmod(F.xxhash64("feature"), F.lit(SLOTS))
    packed = counted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    out = np.zeros(SLOTS // 64, np.int64)
    for row in packed.collect():  # at most SLOTS / 64 rows
        out[row.word] = row.bits
    return out.view(np.uint64)


def count_features(texts: DataFrame, slots: np.ndarray | None = None) -> DataFrame:
    """(feature, n): in how many texts each feature occurs, at least those that fall into ``slots`` if given; '' counts the texts.

    Counts are added up in each task before they are shuffled, and written out
    whenever a task holds many.
    """
    shared = texts.sparkSession.sparkContext.broadcast(slots)  # SLOTS bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number = Counter(), 0

        def out():
            names, values = np.array(list(counts), object), np.fromiter(counts.values(), np.int64, len(counts))
            if shared.value is not None and len(names):
                slot = np.fromiter((xxhash.xxh64_intdigest(f.encode("utf-8"), 42) for f in names), np.uint64, len(names)) & np.uint64(SLOTS - 1)
                kept = (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                names, values = names[kept], values[kept]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.int64())], names=["feature", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(features(text.as_py() or ""))
                number += 1
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([number], pa.int64())], names=["feature", "n"])

    return texts.mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def select_features(positive: DataFrame, everything: DataFrame, most: int = MOST_FEATURES) -> list[str]:
    """At most ``most`` features that are at least three times as frequent among toxic texts, and surely so; the surest first."""
    p, n = ((counted.filter("feature = ''").first() or ("", 0))[1] for counted in (positive, everything))
    both = positive.filter(F.col("n") >= LEAST_DOCS).select("feature", F.col("n").cast("double").alias("a")).join(everything.select("feature", "n"), "feature").filter("feature <> ''")
    a, expected = F.col("a"), F.lit(float(p)) * F.least(F.greatest(F.col("n"), F.col("a")) / F.lit(float(max(n, 1))), F.lit(1 - 1e-9))
    deviance = 2 * (a * F.log(a / expected) - (a - expected))  # of a Poisson count
    sure = both.filter((a >= LEAST_LIFT * expected) & (deviance >= LEAST_DEVIANCE))
    return [r.feature for r in sure.orderBy(deviance.desc(), "feature").limit(most).collect()]


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def score(self, text: str) -> float:
        total = self.bias + sum(w for f in self.weights.keys() & features(text) for w in (self.weights[f],))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss.

    The second part estimates the risk on clean text from unlabelled text; where
    it falls below zero the model has begun to overfit, and the step then goes
    the other way, as the non-negative estimator prescribes.
    """
    rows = positive + unlabelled
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.fromiter((i for r in rows for i in r), np.int64, lengths.sum())
    owner = np.repeat(np.arange(len(rows)), lengths)
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    theta = np.zeros(size + 1)
    theta[size] = np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    loss = lambda m: np.logaddexp(0, -m)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=theta[at], minlength=len(rows)) + theta[size]
        sigma = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = loss(-z[~is_p]).sum() / n_u - prior * loss(-z[is_p]).sum() / n_p
        g = np.zeros(len(rows))
        sign = 1.0 if clean >= 0 else -1.0
        g[~is_p] = sign * sigma[~is_p] / n_u
        g[is_p] = -sign * prior * sigma[is_p] / n_p
        if clean >= 0:
            g[is_p] -= prior * (1 - sigma[is_p]) / n_p
        grad = np.append(np.bincount(at, weights=g[owner], minlength=size), g.sum())
        grad[:size] += DECAY * prior * theta[:size]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:size], float(theta[size])


def _sample(texts: DataFrame, names: list[str], total: int, bound: int) -> list[list[int]]:
    """Feature numbers of at most ``bound`` texts, chosen by a hash of id and text."""
    place = {w: k for k, w in enumerate(names)}
    shared = texts.sparkSession.sparkContext.broadcast(place)  # bounded by MOST_FEATURES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [sorted(known[f] for f in known.keys() & features(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["pick", "found"])

    share = min(1.0, 1.2 * bound / max(total, 1))
    picked = texts.select(F.xxhash64("id", "text").alias("pick"), "text").filter(F.pmod("pick", F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = picked.mapInArrow(mark, "pick long, found array<int>").orderBy(F.pmod("pick", F.lit(1_000_000)), "pick", "found").limit(bound).collect()
    return [list(r.found) for r in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> ToxicModel:
    """Learn from the rows that are not held out.

    Confirmed toxic texts are the positives, all texts that are not held out
    the unlabelled ones, and the class prior is the share of toxic rows among
    the labels that are not held out.  Feature counts cover all of these texts
    and stay in Spark, where the features are chosen; the classifier is fitted
    on at most ``most_positive`` and ``most_unlabelled`` texts.  An id that is
    labelled more than once is one text, toxic if any label says so; other
    columns do not matter.  Without a toxic label, or without documents, the
    model has no features and scores all texts alike.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").alias("toxic")).filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("toxic").isNotNull())
    n, toxic_rows = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = (toxic_rows or 0) / n if n else 0.0
    if not toxic_rows:
        return ToxicModel({}, -30.0)
    prior = min(max(prior, 1e-4), 0.9)
    confirmed = settle(known.filter("toxic = 1").select(F.col("id").alias("_known")).distinct())
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(~held_out(F.col("id")))
    positives = settle(texts.join(confirmed, F.col("id") == F.col("_known"), "left_semi"))
    positive = settle(count_features(positives.select("text")))
    everything = settle(count_features(texts.select("text"), feature_slots(positive.filter(F.col("n") >= LEAST_DOCS))))
    names = select_features(positive, everything)
    if not names:
        return ToxicModel({}, float(np.log(prior / (1 - prior))))
    held = lambda counted: (counted.filter("feature = ''").first() or ("", 0))[1]
    rows = [_sample(positives, names, held(positive), most_positive), _sample(texts, names, held(everything), most_unlabelled)]
    if not rows[0]:
        return ToxicModel({}, float(np.log(prior / (1 - prior))))
    weights, bias = fit_nnpu(*rows, len(names), prior)
    return ToxicModel(dict(zip(names, weights.tolist())), bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the whole text is read; a null text scores as an empty one, equal
    texts score alike, other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # bounded by MOST_FEATURES
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ToxicModel(*shared.value)
        for batch in batches:
            scores = [known.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
