"""Evaluation of models on held-out text."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import halo
from corpusloom.operators import perplexity as op
from corpusloom.operators.training import is_validation
from corpusloom.session import checkpointed


@dataclass(frozen=True)
class Evaluation:
    nll: DataFrame
    windows: DataFrame
    ranking: DataFrame


def bigram_perplexity(
    docs: DataFrame,
    key: str,
    tokens: str,
    model: str,
    held_out: str,
    fraction: float,
    max_length: int,
    stride: int = op.STRIDE,
    seed: int = 0,
) -> Evaluation:
    """One bigram model per value of ``model``, all scored on the held-out texts of one of them.

    The split is the one of the training data, so no model has seen what it is scored on. The
    corpus is scanned for all models together.
    """
    split = docs.withColumn("__val", is_validation(F.col(key), fraction, seed))
    train = split.where(~F.col("__val"))
    held = split.where(F.col("__val") & (F.col(model) == held_out)).select(key, tokens)
    sequence = op.joined_sequence(held, key, tokens)
    total = held.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0))).scalar()
    # a few per cent of the corpus, read three times below
    bigrams = checkpointed(op.sequence_bigrams(sequence, tokens))
    wanted = bigrams.select("a", "b").distinct()
    # the corpus is tokenised once: all counts come from this table
    counts = checkpointed(op.fit(train, model, tokens, only=wanted))
    nll = checkpointed(op.bigram_nll(wanted, op.pairs_of(counts), op.firsts_of(counts)))
    windows = op.window_nll(bigrams, total, nll, max_length, stride)
    return Evaluation(nll, windows, op.perplexity(windows))


def scorer_perplexity(
    docs: DataFrame,
    order: Sequence[str],
    tokens: str,
    models: Mapping[str, halo.ScoredModel],
    separator: Sequence[str] = ("\n\n",),
    stride: int = op.STRIDE,
    deal: bool = True,
) -> DataFrame:
    """(model, window, mean_nll, scored) of plugged-in models over all documents joined to one sequence.

    Each model has the windows of its own length; models of one length share them. The ranking is
    ``operators.perplexity.perplexity`` of the result. Documents follow each other by ``order``, columns of any
    type; a null array counts as no tokens.
    """
    filled = docs.select(*order, F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias(tokens))
    sequence = op.joined_in_order(filled, order, tokens, separator)
    lengths = sorted({m.max_length for m in models.values()})
    # Read once per model and for the total: windows overlap and models share them, so neither passes a shuffle.
    segments = checkpointed(halo.halo_segments(sequence, tokens, lengths[-1], stride), "segments")
    total = segments.agg(F.coalesce(F.max("until"), F.lit(0))).scalar()
    # dealt: a scan of its own for each model, so a task needs one
    scans = [{name: m} for name, m in models.items()] if deal else [models]
    scored = [halo.score_segments(segments, total, scan, stride) for scan in scans]
    return functools.reduce(DataFrame.unionByName, scored)
