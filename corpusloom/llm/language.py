"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A bounded sample of the distinct labelled texts (``Settings.per_lang`` of each language in expectation, chosen by
a hash of the text; copies of a text count once) is turned into sparse counts by Spark tasks. Four fifths train
the weights with the follow-the-regularised-leader update and an elastic net, which leaves most weights at
zero; the rest calibrates one temperature, so that scores are probabilities. A sample of fewer than
``Settings.least_calibrated`` texts trains with all of them and has no temperature (1).

Every text is then read whole, once, without a shuffle. A null text or one without a letter is ``und``
with score 0; so is every text when nothing could be learned. Rows with a null language are not learned
from. Repeated rows are predicted each; other columns pass through, but for lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh_name
from corpusloom.llm.grams import gram_hashes, letter_codes

BITS = 14
WIDTH = 1 << BITS
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: Sampled distinct training texts of each language, in expectation; the bound of all work in training.
    per_lang: int = 800
    #: Smaller samples are not cut for a temperature.
    least_calibrated: int = 50
    sizes: tuple[int, ...] = (1, 2, 3)
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    sizes: tuple[int, ...]

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            index, value = scaled(*counts_of(text, self.sizes), self.idf)
            p = softmax((value @ self.weights[index] + self.bias) / self.temperature)
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores.append(float(p[k]))
        return langs, scores


def counts_of(text: str | None, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text and how often each occurs."""
    codes = letter_codes(text)
    total = np.zeros(WIDTH, np.int64)
    for n in sizes:
        total += np.bincount(gram_hashes(codes, n, BITS), minlength=WIDTH)
    index = np.flatnonzero(total)
    return index, total[index]


def scaled(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF values of unit length; frequencies are dampened by the logarithm."""
    value = (1 + np.log(count)) * idf[index]
    norm = np.sqrt((value * value).sum())
    return index, value / norm if norm > 0 else value


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sample(docs: DataFrame, train_where: str, settings: Settings, text: str, lang: str) -> pa.Table:
    """(lang, buckets, counts) of the sampled texts, in the order of a hash; bounded by the sample."""
    usable = docs.where(F.expr(train_where)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = usable.where("text is not null and lang is not null")
    h = F.xxhash64(F.lit("language"), "text")
    # Distinct texts are estimated, which needs no exchange of the rows; the error only changes the share drawn.
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(settings.per_lang)) / F.col("n"))
    # One row per language.
    shares = {r["lang"]: r["s"] for r in sizes.select("lang", share.alias("s")).collect()}
    wanted = F.lit(0.0)
    for name, s in sorted(shares.items()):
        wanted = F.when(F.col("lang") == name, s).otherwise(wanted)
    drawn = usable.where(F.pmod(h, F.lit(1 << 20)) / float(1 << 20) < wanted)
    # Copies of a drawn text are merged before anything is exchanged.
    picked = drawn.groupBy(h.alias("h"), "lang").agg(F.min("text").alias("text")).select("text", "lang", "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t, settings.sizes) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).cast(pa.string()),
                    batch.column(2).cast(pa.int64()),
                    pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()),
                    pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary()),
                ],
                names=["lang", "h", "i", "c"],
            )

    return picked.mapInArrow(run, "lang string, h long, i binary, c binary").orderBy("h", "lang").toArrow()


def train(
    docs: DataFrame, train_where: str, settings: Settings = Settings(), text: str = "text", lang: str = "lang"
) -> Model | None:
    """``train_where`` is a condition on the rows that may be learned from; None when there are none."""
    sample = _sample(docs, train_where, settings, text, lang)
    names = sample["lang"].to_pylist()
    if not names:
        return None
    langs = sorted(set(names))
    y = np.array([langs.index(n) for n in names])
    rows = [
        (np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.float64))
        for i, c in zip(sample["i"].to_pylist(), sample["c"].to_pylist(), strict=True)
    ]
    document_count = np.bincount(np.concatenate([i for i, _ in rows]), minlength=WIDTH)
    idf = np.log((1 + len(rows)) / (1 + document_count)) + 1
    rows = [scaled(i, c, idf) for i, c in rows]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= settings.least_calibrated else np.zeros(len(rows), bool)
    weights, bias = _follow_leader([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(langs), settings)
    z = np.array([v @ weights[i] + bias for (i, v), h in zip(rows, held, strict=True) if h])
    temperature = _temperature(z, y[held]) if held.any() else 1.0
    return Model(langs, idf, weights, bias, temperature, settings.sizes)


def _follow_leader(rows, y, classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate updates; a weight is zero while its sum of gradients stays within the l1 bound."""
    z = np.zeros((WIDTH + 1, classes))
    n = np.zeros((WIDTH + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for (index, value), label in zip(rows, y, strict=True):
            index, value = np.append(index, WIDTH), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            grown = ni + g * g
            z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / s.alpha * w
            n[index] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(z / np.exp(t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def with_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(dict(model.__dict__))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(**shared.value)
        for texts in batches:
            langs, scores = known.predict(texts)
            yield pd.DataFrame({"lang": langs, "score": scores})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    guess = F.pandas_udf(run, "lang string, score double")(F.col(text))
    # \p{L} as Java understands it: any letter.
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    guessed, lettered = fresh_name(docs, "__guess"), fresh_name(docs, "__letters")
    df = docs.select(*kept, guess.alias(guessed), letters.alias(lettered))
    return df.select(
        *kept,
        F.when(F.col(lettered), F.col(guessed)["lang"]).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col(lettered), F.col(guessed)["score"]).otherwise(0.0).alias("score"),
    )
