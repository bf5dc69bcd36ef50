"""Training data: splits, fill-in-the-middle permutation, packing, shuffling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once, let
from corpusloom.functions.rng import draw_bits, permuted_rank, uniform
from corpusloom.functions.text import FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX
from corpusloom.functions.tokens import regex_tokens
from corpusloom.operators.prefix import random_rank, running_total, starts_in_order

# Defaults of the data preparation.
VALIDATION_FRACTION = 0.005
SEQ_LENGTH = 1024
SEQUENCES_PER_BUFFER = 1024
CHARS_PER_TOKEN = 3.6
FIM_RATE, FIM_SPM_RATE = 0.5, 0.5

EOS = "<eos>"
_BUCKET_BITS = 12


def take_skip(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(first n rows by key, all others). The key is unique."""
    border = df.select(key).orderBy(key).limit(n).agg(F.max(key)).scalar()
    if border is None:
        return df.limit(0), df
    return df.where(F.col(key) <= border), df.where(F.coalesce(F.col(key) > border, F.lit(True)))


def is_validation(key: Column, fraction: float = VALIDATION_FRACTION, seed: int = 0) -> Column:
    """Seeded split by row key: the same rows in every run, whatever the partitioning."""
    return uniform("v", key, seed=seed) < fraction


def train_val_split_exact(
    df: DataFrame, key: str, fraction: float = VALIDATION_FRACTION, seed: int = 0
) -> DataFrame:
    """Add ``is_validation`` for exactly ``ceil(fraction * rows)`` rows: those with the smallest draws.

    A histogram of the draws says in which bucket the border lies; only the rows of that one bucket
    (1 in 4096) are ranked.
    """
    bits = draw_bits("v", F.col(key), seed=seed)
    bucket = F.shiftright(bits, 32 - _BUCKET_BITS)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(so_far), F.lit(0))
    # at most 2**_BUCKET_BITS rows from here on
    ranked = counts.withColumn("before", before).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = F.ceil(F.round(F.col("total") * F.lit(fraction), 9))
    border = (
        ranked.where((F.col("before") < wanted) & (wanted <= F.col("before") + F.col("n")))
        .select("bucket", (wanted - F.col("before")).alias("missing"))
        .first()
    )
    if border is None:
        return df.withColumn("is_validation", F.lit(False))
    clear = df.where(bucket != border["bucket"]).withColumn("is_validation", bucket < border["bucket"])
    close = df.where(bucket == border["bucket"]).withColumn("__bits", bits)
    # the draws of one bucket differ in their low bits only: move those up to spread them again
    close = close.withColumn("__low", F.shiftleft("__bits", _BUCKET_BITS).bitwiseAND(F.lit(2**32 - 1)))
    close = random_rank(close, "__low", key, "__rank").withColumn(
        "is_validation", F.col("__rank") < border["missing"]
    )
    return clear.unionByName(close.drop("__bits", "__low", "__rank"))


def corpus_stats(df: DataFrame, n_chars: str, *by: str) -> DataFrame:
    """Rows and characters per group, e.g. by language and split."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n_chars).cast("bigint").alias("chars")
    )


def shuffle_rank(df: DataFrame, key: str, out: str = "rank", seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add the position of each row in a seeded shuffle of the whole table."""
    keyed = df.withColumn("__bits", draw_bits("shuffle", F.lit(epoch), F.col(key), seed=seed))
    return random_rank(keyed, "__bits", key, out).drop("__bits")


def shuffle_rows(
    df: DataFrame, *keys: str, seed: int = 0, epoch: int = 0, partitions: int | None = None
) -> DataFrame:
    """Rows in seeded random order: across partitions by range, and within each partition."""
    draw = draw_bits("shuffle", F.lit(epoch), *[F.col(k) for k in keys], seed=seed)
    keyed = df.withColumn("__bits", draw)
    spread = (
        keyed.repartitionByRange(partitions, "__bits") if partitions else keyed.repartitionByRange("__bits")
    )
    return spread.sortWithinPartitions("__bits", *keys).drop("__bits")


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch; the epoch number salts later draws."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def epoch_positions(
    df: DataFrame, rank: str, n: int, epoch: str = "epoch", out: str = "position", seed: int = 0
) -> DataFrame:
    """Add the place of every row in the order of its epoch; ``rank`` counts the ``n`` rows of an epoch from 0.

    Each epoch has an order of its own, and no epoch is sorted: a place is a function of seed, epoch and rank.
    """
    return df.withColumn(out, permuted_rank(F.col(rank), n, "epoch", F.col(epoch), seed=seed))


def chars_token_ratio(
    df: DataFrame, key: str, text: str = "text", n: int = 400, pattern: str | None = None
) -> DataFrame:
    """Characters per token over the first ``n`` rows by key."""
    tokens = regex_tokens(F.col(text), pattern) if pattern else regex_tokens(F.col(text))
    return (
        df.select(key, text)
        .orderBy(key)
        .limit(n)
        .agg((F.sum(F.length(text)) / F.sum(F.size(tokens))).alias("chars_per_token"))
    )


def fim_permute(
    tokens: Column,
    *key: Column,
    fim_rate: float = FIM_RATE,
    fim_spm_rate: float = FIM_SPM_RATE,
    markers: tuple[str, str, str] | None = (FIM_PREFIX, FIM_SUFFIX, FIM_MIDDLE),
    truncate: bool = False,
    seed: int = 0,
) -> Column:
    """struct(mode, tokens): fill-in-the-middle permutation of a token array.

    With probability ``fim_rate`` the tokens are cut at two random places; the order is then
    prefix, suffix, middle ('psm'), or suffix, prefix, middle with probability ``fim_spm_rate``
    ('spm'). ``truncate`` keeps the length by cutting the suffix, and leaves rows alone ('none')
    whose suffix is too short for that.
    """
    if markers is None:
        if fim_rate > 0:
            raise ValueError("markers are required when fim_rate > 0")
        return F.struct(F.lit("none").alias("mode"), tokens.alias("tokens"))

    pre, suf, mid = (F.array(F.lit(m)) for m in markers)
    extra = len(markers)

    def place(salt: str, n: Column) -> Column:
        return F.floor(uniform(salt, *key, seed=seed) * (n + 1)).cast("int")

    def permuted(t: Column, cut: Column) -> Column:
        n = F.size(t)
        low, high = F.array_min(cut), F.array_max(cut)
        prefix, middle = F.slice(t, F.lit(1), low), F.slice(t, low + 1, high - low)
        rest = n - high
        kept = rest - extra if truncate else rest
        suffix = F.slice(t, high + 1, F.greatest(kept, F.lit(0)))
        apply = uniform("f", *key, seed=seed) < fim_rate
        if truncate:
            apply = apply & (rest > extra)

        def result(mode: str, value: Column) -> Column:
            return F.struct(F.lit(mode).alias("mode"), value.alias("tokens"))

        return (
            F.when(~apply, result("none", t))
            .when(
                uniform("s", *key, seed=seed) < fim_spm_rate,
                result("spm", F.concat(pre, suf, suffix, mid, prefix, middle)),
            )
            .otherwise(result("psm", F.concat(pre, prefix, suf, suffix, mid, middle)))
        )

    return let(
        tokens,
        lambda t: let(
            F.array(place("a", F.size(t)), place("b", F.size(t))), lambda cut: permuted(t, cut)
        ),
    )


def buffer_size(
    seq_length: int = SEQ_LENGTH,
    chars_per_token: float = CHARS_PER_TOKEN,
    sequences: int = SEQUENCES_PER_BUFFER,
) -> int:
    """Characters per shard."""
    return math.ceil(seq_length * chars_per_token * sequences)


def assign_shards(
    df: DataFrame, key: str, n_chars: str, bound: int, by: tuple[str, ...] = (), out: str = "shard"
) -> DataFrame:
    """Add the shard number: consecutive rows by key, about ``bound`` characters per shard.

    A row belongs to the shard in which it starts, so a shard never exceeds the bound by more than
    its last row.
    """
    return running_total(df, key, n_chars, "__chars_before", by).withColumn(
        out, F.floor(F.col("__chars_before") / bound).cast("bigint")
    ).drop("__chars_before")


def shards_in_order(
    df: DataFrame, order: Sequence[str], n_chars: str, bound: int, out: str = "shard"
) -> DataFrame:
    """:func:`assign_shards` in the order of columns of any type; only they and the sizes pass windows."""
    placed = starts_in_order(df, order, n_chars, "__chars_before")
    return placed.withColumn(out, F.floor(F.col("__chars_before") / bound).cast("bigint")).drop("__chars_before")


def pack_constant_length(
    df: DataFrame,
    key: str,
    tokens: str,
    seq_length: int = SEQ_LENGTH,
    eos: str = EOS,
    by: tuple[str, ...] = (),
    bounded: bool = False,
) -> DataFrame:
    """Concatenate token arrays, each followed by ``eos``, and cut into pieces of ``seq_length``.

    Gives (by…, piece, input_ids, labels). The short piece at the end of each ``by`` group is
    dropped. Tokens are not exploded: a row sends one slice to each piece it touches, and a piece
    never holds more than ``seq_length`` tokens, so long rows and large groups cause no skew.
    ``bounded`` says that the ``by`` groups have a limited size, as shards do: then one shuffle by
    group serves both the positions and the pieces.
    """
    ended = df.select(*by, key, F.concat(F.col(tokens), F.array(F.lit(eos))).alias("__t"))
    sized = ended.withColumn("__n", F.size("__t").cast("bigint"))
    if bounded:
        before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        placed = sized.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    else:
        placed = running_total(sized, key, "__n", "__start", by)
    return _pieces(placed, seq_length, by)


def pack_in_order(
    df: DataFrame, order: Sequence[str], tokens: str, seq_length: int = SEQ_LENGTH, eos: str = EOS
) -> DataFrame:
    """(piece, input_ids, labels) as :func:`pack_constant_length`, in the order of columns of any type.

    Keys may repeat and may be null, which comes first; rows with equal keys follow each other in no promised
    order. Only keys and sizes pass windows, whatever share of the rows a key or a range of keys has.
    """
    ended = df.select(*order, F.concat(F.col(tokens), F.array(F.lit(eos))).alias("__t"))
    sized = ended.withColumn("__n", F.size("__t").cast("bigint"))
    return _pieces(starts_in_order(sized, order, "__n", "__start"), seq_length)


def _pieces(placed: DataFrame, seq_length: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pieces from (by…, __t, __n, __start): each row sends a slice to every piece it touches."""
    first = F.floor(F.col("__start") / seq_length)
    last = F.floor((F.col("__start") + F.col("__n") - 1) / seq_length)
    touched = placed.select(
        *by, "__t", "__start", "__n", F.explode(F.sequence(first, last)).alias("piece")
    )
    begin = F.greatest(F.col("piece") * seq_length, F.col("__start"))
    end = F.least((F.col("piece") + 1) * seq_length, F.col("__start") + F.col("__n"))
    part = F.slice(
        F.col("__t"), (begin - F.col("__start") + 1).cast("int"), (end - begin).cast("int")
    )
    slices = touched.select(*by, "piece", F.struct(begin.alias("at"), part.alias("part")).alias("__slice"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list("__slice")), lambda s: s["part"]))
    return (
        slices.groupBy(*by, "piece")
        .agg(joined.alias("input_ids"))
        .where(F.size("input_ids") == seq_length)
        .withColumn("labels", F.col("input_ids"))
    )


def whole_pieces(df: DataFrame, tokens: str, seq_length: int, by: tuple[str, ...]) -> DataFrame:
    """(by…, piece, input_ids): every token array cut into pieces of ``seq_length``; what is left at its end is dropped."""
    count = F.floor(F.size(tokens) / seq_length).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.slice(F.col(tokens), i * seq_length + 1, F.lit(seq_length))
    )
    return explode_once(df, F.when(count > 0, cuts), *by, pos="piece", value="input_ids")
