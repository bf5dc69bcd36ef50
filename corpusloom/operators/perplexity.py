"""Strided-window perplexity of many models in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once
from corpusloom.operators.prefix import running_total, starts_in_order

STRIDE = 512
SMOOTHING = 0.1
MAX_BROADCAST_BIGRAMS = 1_000_000
# Bits of the hash of a bigram, where there are more of them: 32 MB in all.
HASH_BITS = 28


def ppl_window(t: Column, n: Column, max_length: int, stride: int = STRIDE) -> Column:
    """Number of the window that scores the token at position ``t`` of ``n``; null if none does.

    Windows start every ``stride`` tokens and are ``max_length`` long; each scores only what the
    one before has not seen, and the first one only its last ``stride`` tokens. The first token of
    a window has no context there, so it is not scored.
    """
    if max_length < stride:
        raise ValueError("max_length must not be smaller than stride")
    window = F.when(t < max_length, 0).otherwise(1 + F.floor((t - max_length) / stride))
    scored = F.when(n > max_length, t >= max_length - stride).otherwise(t >= n - F.least(F.lit(stride), n))
    return F.when(scored & (t > window * stride), window.cast("bigint"))


def joined_sequence(
    docs: DataFrame, key: str, tokens: str, separator: list[str] | None = None
) -> DataFrame:
    """Add ``start``: position of a document's first token when all are joined to one sequence.

    ``separator`` holds the tokens between two documents; it becomes part of the later one, whose
    array then begins with it.
    """
    gap = F.array(*[F.lit(s) for s in separator or []]).cast("array<string>")
    low = docs.agg(F.min(key)).scalar() if separator else None
    full = F.col(tokens) if low is None else F.when(F.col(key) == low, F.col(tokens)).otherwise(
        F.concat(gap, F.col(tokens))
    )
    sized = docs.withColumn(tokens, full).withColumn("n_tokens", F.size(tokens).cast("bigint"))
    return running_total(sized, key, "n_tokens", "start")


def joined_in_order(
    docs: DataFrame, order: Sequence[str], tokens: str, separator: Sequence[str] = ()
) -> DataFrame:
    """``joined_sequence`` in the order of columns of any type; keys may repeat and may be null.

    A document is first counted with a separator in front. The one that nothing comes before has none, so all
    others move up by its length.
    """
    gap = F.array(*[F.lit(s) for s in separator]).cast("array<string>")
    sized = docs.withColumn("n_tokens", F.size(tokens).cast("bigint") + len(separator))
    placed = starts_in_order(sized, order, "n_tokens", "start")
    if not separator:
        return placed
    first = F.col("start") == 0
    return placed.select(
        *docs.drop(tokens).columns,
        F.when(first, F.col(tokens)).otherwise(F.concat(gap, F.col(tokens))).alias(tokens),
        F.when(first, F.col("n_tokens") - len(separator)).otherwise(F.col("n_tokens")).alias("n_tokens"),
        F.when(first, 0).otherwise(F.col("start") - len(separator)).alias("start"),
    )


def _pairs(tokens: Column) -> Column:
    """array<struct<0, 1>> of neighbouring tokens."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(tokens, F.lit(1), rest).alias("0"), F.slice(tokens, F.lit(2), rest).alias("1")
    )


def sequence_bigrams(sequence: DataFrame, tokens: str) -> DataFrame:
    """(t, a, b) for every position t > 0 of a joined sequence.

    Pairs inside a document need no shuffle; the pairs across two documents come from a join of
    document ends with document starts.
    """
    filled = sequence.where(F.col("n_tokens") > 0)
    inside = filled.select("start", F.posexplode(_pairs(F.col(tokens))).alias("i", "p")).select(
        (F.col("start") + F.col("i") + 1).alias("t"), F.col("p.0").alias("a"), F.col("p.1").alias("b")
    )
    ends = filled.select(
        (F.col("start") + F.col("n_tokens")).alias("t"), F.element_at(tokens, -1).alias("a")
    )
    starts = filled.select(F.col("start").alias("t"), F.element_at(tokens, 1).alias("b"))
    return inside.unionByName(ends.join(starts, "t"))


def _may_be_in(only: DataFrame, a: Column, b: Column) -> Column:
    """False only where (a, b) is not in ``only``: a bit for the hash of every bigram, in a table of fixed size."""

    def slot(a: Column, b: Column) -> Column:
        return F.pmod(F.xxhash64(a, b), F.lit(1 << HASH_BITS))

    slots = only.select(slot(F.col("a"), F.col("b")).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(1 << (HASH_BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = only.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def marked(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return marked(slot(a, b))


def fit(train: DataFrame, model: str, tokens: str, only: DataFrame | None = None) -> DataFrame:
    """(model, a, b, n, followed): one pass over the tokens for all counts of each model.

    A row counts the places where ``b`` follows ``a`` in a document; ``b`` is null at the end of one. With
    ``only``, the bigrams (a, b) that are going to be scored, all others count under a null ``b`` as well: there
    ``followed`` says how many of the ``n`` places have a next token. ``only`` is broadcast while it is small; beyond
    that a table of bits by hash tells what is surely not in it, so a few others keep rows of their own.
    """
    sized = train.select(F.col(model).alias("model"), tokens)
    follower = F.transform(
        tokens, lambda t, i: F.struct(t.alias("a"), F.get(F.col(tokens), i + 1).alias("b"))
    )
    rows = explode_once(sized.withColumn("__f", follower), F.col("__f"), "model", value="f").select(
        "model", "f.a", "f.b"
    )
    followed = F.col("b").isNotNull()
    if only is not None and only.limit(MAX_BROADCAST_BIGRAMS + 1).count() <= MAX_BROADCAST_BIGRAMS:
        few = only.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
        marked = rows.join(F.broadcast(few), (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left")
        rows = marked.select("model", "a", F.col("__b").alias("__wanted"), "b")
    elif only is not None:
        rows = rows.withColumn("__wanted", F.when(_may_be_in(only, F.col("a"), F.col("b")), F.col("b")))
    else:
        rows = rows.withColumn("__wanted", F.col("b"))
    return rows.groupBy("model", "a", F.col("__wanted").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(followed.cast("bigint")).alias("followed")
    )


def pairs_of(counts: DataFrame) -> DataFrame:
    """(model, a, b, n) from the counts of :func:`fit`."""
    return counts.where("b is not null").select("model", "a", "b", "n")


def firsts_of(counts: DataFrame) -> DataFrame:
    """(model, a, n): the vocabulary of each model; n tells how often a token has one behind it."""
    return counts.groupBy("model", "a").agg(F.sum("followed").alias("n"))


def _per_model(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Counts of all models side by side in a map: at most one entry per model."""
    return counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("model", "n"))).alias(name)
    )


def bigram_nll(
    wanted: DataFrame, pairs: DataFrame, firsts: DataFrame, k: float = SMOOTHING
) -> DataFrame:
    """(a, b, model, nll) for each wanted bigram (a, b) and every model, with add-k smoothing.

    ``pairs`` and ``firsts`` are the counts of :func:`fit`, by :func:`pairs_of` and :func:`firsts_of`.
    """
    sizes = firsts.groupBy("model").agg(F.count(F.lit(1)).alias("v"))
    models = sizes.agg(F.sort_array(F.collect_list(F.struct("model", "v")))).scalar()
    known = firsts.join(wanted.select("a").distinct(), "a", "left_semi")
    found = (
        wanted.join(_per_model(pairs, ["a", "b"], "pair_n"), ["a", "b"], "left")
        .join(_per_model(known, ["a"], "first_n"), "a", "left")
        .withColumn("m", F.explode(models))
    )

    def count(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(name), F.col("m.model")), F.lit(0))

    share = (count("pair_n") + k) / (count("first_n") + F.lit(k) * F.col("m.v"))
    return found.select("a", "b", F.col("m.model").alias("model"), (-F.log(share)).alias("nll"))


def window_nll(
    bigrams: DataFrame, n: Column, nll: DataFrame, max_length: int, stride: int = STRIDE
) -> DataFrame:
    """(model, window, mean_nll, scored): every model over every window.

    Equal bigrams of a window are counted before the join, so a frequent one is a single row per window. The
    table of likelihoods is broadcast while its counted size is small, so frequent bigrams don't meet in one task.
    """
    if nll.limit(MAX_BROADCAST_BIGRAMS + 1).count() <= MAX_BROADCAST_BIGRAMS:
        nll = F.broadcast(nll)
    in_window = bigrams.withColumn("window", ppl_window(F.col("t"), n, max_length, stride)).where(
        F.col("window").isNotNull()
    )
    counted = in_window.groupBy("window", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(nll, ["a", "b"])
        .groupBy("model", "window")
        .agg(
            (F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("mean_nll"),
            F.sum("n").alias("scored"),
        )
    )


def perplexity(windows: DataFrame) -> DataFrame:
    """(model, ppl), best first: exp of the mean of the window means; all windows weigh the same."""
    return (
        windows.groupBy("model")
        .agg(F.exp(F.avg("mean_nll")).alias("ppl"))
        .orderBy("ppl", "model")
    )
