"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training uses a bounded sample of labelled documents (``Settings.per_class`` of each class in expectation,
chosen by a hash of doc_id; of several rows of one doc_id the text with the smallest hash is taken). Spark
counts, for every hashed n-gram, the sampled texts of each class that contain it; the ratio of the two shares
is the n-gram's log-count ratio. The n-grams with the clearest ratios become features whose value is their
ratio, and logistic regression weighs them; rows count by the share of their class that was sampled, so scores
follow the true class sizes.

Scoring reads every text whole, once, without a shuffle. Null and empty texts have no features; their
score is the bias. Labels: null labels are left out, several labels of a document count as the largest.
Without labelled rows of both classes every score is the share of class 1 (0 without any).
Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.grams import gram_hashes, letter_codes
from corpusloom.session import checkpointed

BITS = 20


@dataclass(frozen=True)
class Settings:
    #: Sampled training rows of each class, in expectation; the bound of all work in training.
    per_class: int = 6000
    features: int = 2048
    sizes: tuple[int, ...] = (4, 5)
    #: Texts of a class that must hold an n-gram.
    least_texts: int = 3
    steps: int = 150
    penalty: float = 1e-4


@dataclass
class Model:
    bias: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sizes: tuple[int, ...] = (4, 5)

    def scorer(self):
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.buckets] = np.arange(len(self.buckets))

        def score(text: str | None) -> float:
            found = features_of(text, slot, self.sizes)
            return float(1 / (1 + np.exp(-(self.bias + self.weights[found].sum()))))

        return score


def features_of(text: str | None, slot: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """The distinct features that occur in a text."""
    codes = letter_codes(text)
    hits = [slot[gram_hashes(codes, n, BITS)] for n in sizes]
    hits = np.concatenate([h[h >= 0] for h in hits])
    return np.unique(hits)


def sampled(docs: DataFrame, labels: DataFrame, train: str, per_class: int, text: str, doc_id: str, label: str):
    """(text, y, h) of the sample, stored, and the rows of each class before sampling; h orders it, by a hash of the id."""
    clean = (
        labels.where(F.col(label).isNotNull() & F.expr(train))
        .groupBy(F.col(doc_id).alias("id"))
        .agg((F.max(label) > 0).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, min(1.0, per_class / n)).otherwise(share)
    chosen = clean.where(draw < share)
    # Bounded by the sampling: about 2 * per_class rows of two numbers.
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # One text per document, also where an id stands in many rows; merged before they are exchanged.
    picked = found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    picked = picked.select("text", "y", F.xxhash64(F.lit("order"), "id").alias("h"))
    return checkpointed(picked, "toxic-sample"), sizes


def _class_counts(sample: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(bucket, pos, neg): sampled texts of each class with an n-gram in the bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = letter_codes(text)
                counts[y, np.unique(np.concatenate([gram_hashes(codes, n, BITS) for n in sizes]))] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))],
                names=["bucket", "pos", "neg"],
            )

    return (
        sample.select("text", "y")
        .mapInArrow(run, "bucket long, pos long, neg long")
        .groupBy("bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def train(
    docs: DataFrame, labels: DataFrame, train_where: str, settings: Settings = Settings(), text: str = "text",
    doc_id: str = "doc_id", label: str = "toxic",
) -> Model:
    """``train_where`` is a condition on the label rows that may be learned from."""
    sample, sizes = sampled(docs, labels, train_where, settings.per_class, text, doc_id, label)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(n) < 2:
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), sizes=settings.sizes)
    p, q = (F.col("pos") + 1) / (n[1] + 2), (F.col("neg") + 1) / (n[0] + 2)
    ratio = F.log(p / q)
    clear = F.abs(ratio) / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    best = (
        _class_counts(sample, settings.sizes)
        .where(F.greatest("pos", "neg") >= settings.least_texts)
        .select("bucket", ratio.alias("r"), clear.alias("z"))
        .orderBy(F.desc("z"), "bucket")
        .limit(settings.features)
        .collect()
    )
    buckets = np.array([b["bucket"] for b in best], np.int64)
    ratios = np.array([b["r"] for b in best])
    found, ends, y = _sample_features(sample, buckets, settings.sizes)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    w, bias = _fit(found, ends, y, weight / weight.sum(), ratios, settings)
    return Model(bias, buckets, w * ratios, settings.sizes)


def _sample_features(sample: DataFrame, buckets: np.ndarray, sizes: tuple[int, ...]):
    """Features of all sampled texts as one array with ends, and their labels; bounded by the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[buckets] = np.arange(len(buckets))
        for batch in batches:
            rows = [features_of(t, slot, sizes).astype(np.int16) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).cast(pa.int32()), batch.column(2)],
                names=["f", "y", "h"],
            )

    found = sample.select("text", "y", "h").mapInArrow(run, "f binary, y int, h long")
    got = found.orderBy("h", "f", "y").toArrow()
    rows = [np.frombuffer(b, np.int16) for b in got["f"].to_pylist()]
    ends = np.cumsum([len(r) for r in rows])
    found = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    return found, ends, np.array(got["y"].to_pylist(), np.int64)


def _fit(found, ends, y, weight, ratios, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by Adam steps over the whole sample."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    w = np.ones(len(ratios)) * 0.1
    bias = float(np.log(max(weight[y == 1].sum(), 1e-9) / max(weight[y == 0].sum(), 1e-9)))
    theta = np.append(w, bias)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        z = theta[-1] + np.bincount(row, weights=(theta[:-1] * ratios)[found], minlength=len(ends))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(
            ratios * np.bincount(found, weights=error[row], minlength=len(ratios)) + settings.penalty * theta[:-1],
            error.sum(),
        )
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def with_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, the probability of label 1, and predicted, 1 from a score of 0.5 on."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(
        {"bias": model.bias, "buckets": model.buckets, "weights": model.weights, "sizes": model.sizes}
    )

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Model(**shared.value).scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.select(*kept, F.pandas_udf(run, T.DoubleType())(F.col(text)).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
