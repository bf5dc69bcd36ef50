"""Overlapping windows over a joined sequence, with the context each one needs, for models that score tokens.

Windows are ``max_length`` tokens long and begin every ``stride`` tokens, so most tokens stand in several of
them. Windows that follow each other are one segment, ``SEGMENT_LENGTHS`` lengths of a window long. A document of
the sequence sends to every segment it touches the slice that lies in it; the slices of a segment meet in one row
and are cut into windows there, so a token passes the shuffle about once and not once per window. A document of
any length is many small slices, and many small documents are few tokens per segment, so neither is a hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once
from corpusloom.operators.perplexity import STRIDE

#: Lengths of a window that a segment holds; one more of them, less the stride, stands in its neighbour as well.
SEGMENT_LENGTHS = 8

#: From a batch of token lists to the negative log-likelihood of every token, given those before it in its list.
#: The first number of each list is not used: nothing stands before that token.
Scorer = Callable[[list[list]], Sequence[Sequence[float]]]


@runtime_checkable
class BlockScorer(Protocol):
    """A scorer that can take windows of one length as a block too, for models that work on arrays."""

    def score_block(self, codes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The numbers of a scorer as an array like ``codes``, whose rows are windows; ``words`` has the token of each code."""


@dataclass(frozen=True)
class ScoredModel:
    """A scorer, made once per Python worker, and the number of tokens it can look at."""

    factory: Callable[[], Scorer]
    max_length: int
    batch: int = 16


def halo_segments(sequence: DataFrame, tokens: str, max_length: int, stride: int = STRIDE) -> DataFrame:
    """(segment, windows, until, tokens) of a sequence with ``start`` and ``n_tokens``.

    Segment s has the ``windows`` windows from s * windows on, and all tokens of theirs. ``until`` is the position
    behind its last token, so the largest one is the length of the sequence.
    """
    if max_length < stride:
        raise ValueError("max_length must not be smaller than stride")
    each = math.ceil(SEGMENT_LENGTHS * max_length / stride)
    filled = sequence.where(F.col("n_tokens") > 0)
    end = F.col("start") + F.col("n_tokens")
    first = F.greatest(F.floor((F.col("start") - max_length) / stride) + 1, F.lit(0))
    last = F.ceil(end / stride) - 1
    touched = explode_once(
        filled.withColumn("__segments", F.sequence(F.floor(first / each), F.floor(last / each))), F.col("__segments"),
        tokens, "start", "n_tokens", value="segment",
    )
    begin = F.col("segment") * (each * stride)
    at = F.greatest(begin, F.col("start"))
    until = F.least(begin + ((each - 1) * stride + max_length), F.col("start") + F.col("n_tokens"))
    part = F.slice(F.col(tokens), (at - F.col("start") + 1).cast("int"), (until - at).cast("int"))
    slices = touched.select("segment", until.alias("until"), F.struct(at.alias("at"), part.alias("part")).alias("__slice"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list("__slice")), lambda s: s["part"]))
    return slices.groupBy("segment").agg(
        F.lit(each).alias("windows"), F.max("until").alias("until"), whole.alias("tokens")
    )


def windows_of(segments: DataFrame, total: Column, max_length: int, stride: int = STRIDE) -> DataFrame:
    """(window, tokens, first_scored) of :func:`halo_segments` that were made for this length or a larger one.

    ``total`` is the length of the sequence. The last window is the first one that reaches the end. A window scores
    what the one before did not reach, the first one only its last ``stride`` tokens; ``first_scored`` is the place
    in the window where that begins, but not 0, as the first token has no context.
    """
    if max_length < stride:
        raise ValueError("max_length must not be smaller than stride")
    last_window = F.greatest(F.ceil((F.col("__total") - max_length) / stride), F.lit(0))
    low = F.col("segment") * F.col("windows")
    high = F.least(low + F.col("windows") - 1, last_window)
    sized = segments.withColumn("__total", total)
    # A slice behind the explode is compiled; inside a lambda it would pass over the segment for every window.
    numbered = explode_once(
        sized.withColumn("__low", low).withColumn("__windows", F.when(low <= last_window, F.sequence(low, high))),
        F.col("__windows"), "__total", "__low", "tokens", value="window",
    )
    begin = ((F.col("window") - F.col("__low")) * stride + 1).cast("int")
    windows = numbered.select("__total", "window", F.slice("tokens", begin, F.lit(max_length)).alias("tokens"))
    new = F.when(F.col("window") == 0, F.least(F.lit(stride), F.col("__total"))).otherwise(
        F.least(F.lit(stride), F.col("__total") - (F.col("window") - 1) * stride - max_length)
    )
    first_scored = F.greatest(F.size("tokens") - F.least(new, F.size("tokens")), F.lit(1)).cast("int")
    return windows.select("window", "tokens", first_scored.alias("first_scored"))


def halo_windows(
    sequence: DataFrame, tokens: str, total: Column, max_length: int, stride: int = STRIDE
) -> DataFrame:
    """(window, tokens, first_scored) of a sequence with ``start`` and ``n_tokens``, ``total`` tokens long."""
    return windows_of(halo_segments(sequence, tokens, max_length, stride), total, max_length, stride)


def score_segments(
    segments: DataFrame, total: Column, models: Mapping[str, ScoredModel], stride: int = STRIDE
) -> DataFrame:
    """(model, window, mean_nll, scored): every model over every window of its own length.

    ``segments`` are those of :func:`halo_segments` for the largest length or a larger one. They go to Python whole and
    are cut there into the windows of :func:`windows_of`, so a token is handed over once and not once per window and
    model. Windows without a token to score are left out.
    """
    models = dict(models)
    if min(m.max_length for m in models.values()) < stride:
        raise ValueError("max_length must not be smaller than stride")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Scorer] = {}
        for batch in batches:
            found: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
            columns = (batch[c].to_numpy() for c in ("segment", "windows", "__total"))
            lists = batch["tokens"]
            for i, (segment, each, length) in enumerate(zip(*columns, strict=True)):
                codes, words = _coded(lists[i].values)
                for name, model in models.items():
                    if name not in loaded:
                        loaded[name] = model.factory()
                    args = codes, words, int(segment) * int(each), int(each), int(length), stride
                    found += [(name, *part) for part in _scored(loaded[name], model, *args)]
            names = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]) if found else [], pa.string())
            numbers = [np.concatenate([f[k] for f in found]) if found else [] for k in (1, 2, 3)]
            arrays = [pa.array(n, t) for n, t in zip(numbers, (pa.int64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([names, *arrays], names=["model", "window", "mean_nll", "scored"])

    sized = segments.select("segment", "windows", "tokens", total.cast("bigint").alias("__total"))
    return sized.mapInArrow(score, "model string, window bigint, mean_nll double, scored bigint")


def _coded(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, the token of each number); the last one is null."""
    coded = tokens.dictionary_encode()
    words = np.array([*coded.dictionary.to_pylist(), None], object)
    codes = coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)
    # numbers of 16 bits are sorted by their bits
    return codes.astype(np.uint16 if len(words) <= 1 << 16 else np.int32), words


def _scored(
    scorer: Scorer, model: ScoredModel, codes: np.ndarray, words: np.ndarray, low: int, each: int, total: int, stride: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, means, tokens scored) of the windows of a segment, which has those from ``low`` on."""
    length = model.max_length
    last = max(-(-(total - length) // stride), 0)
    count = min(each, last - low + 1)
    # all but the last window of the sequence are full
    full = min(count, max(0, (len(codes) - length) // stride + 1))
    blocks = []
    if full > 0:
        at = np.lib.stride_tricks.sliding_window_view(codes, length)[:: stride][:full]
        blocks.append((low + np.arange(full), at, min(stride, total)))
    for window in range(low + full, low + count):
        begin = (window - low) * stride
        new = min(stride, total) if window == 0 else min(stride, total - (window - 1) * stride - length)
        blocks.append((np.array([window]), codes[None, begin : begin + length], new))
    for windows, block, new in blocks:
        size = block.shape[1]
        first = max(size - min(new, size), 1)
        if first >= size:
            continue
        if isinstance(scorer, BlockScorer):
            kept = scorer.score_block(block, words)[:, first:]
            yield windows, kept.sum(axis=1) / (size - first), np.full(len(windows), size - first)
            continue
        means = []
        for start in range(0, len(block), model.batch):
            lists = words[block[start : start + model.batch]].tolist()
            means += [math.fsum(list(nll)[first:]) / (size - first) for nll in scorer(lists)]
        yield windows, np.array(means), np.full(len(windows), size - first)
