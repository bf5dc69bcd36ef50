"""From a corpus to shuffled training sequences of constant length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once
from corpusloom.functions.rng import draw_bits
from corpusloom.functions.tokens import CODE_TOKEN, regex_tokens
from corpusloom.operators import training as op
from corpusloom.operators.prefix import random_rank, running_total
from corpusloom.session import checkpointed

# Up to so many shards of all epochs their first places are broadcast; the number is checked before.
MOST_BROADCAST_SHARDS = 1_000_000


@dataclass(frozen=True)
class TrainingConfig:
    seq_length: int = 1024
    fim_rate: float = 0.5
    fim_spm_rate: float = 0.0
    validation_fraction: float = 0.005
    chars_per_token: float = 3.6
    sequences_per_buffer: int = 1024
    seed: int = 0


def prepare_training_data(
    docs: DataFrame,
    key: str,
    text: str,
    config: TrainingConfig = TrainingConfig(),
    token_pattern: str = CODE_TOKEN,
    ranked: bool = True,
) -> DataFrame:
    """(is_validation, shard, piece, rank, input_ids, labels).

    Split, tokenise, permute, pack per shard, shuffle. ``docs`` may have ``n_chars``; otherwise the
    length of the text is taken. ``rank`` is the place in the shuffled order of its split. Leave it
    out for :func:`corpusloom.sources.tables.write_sequences`, which shuffles while writing.
    """
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.length(text)
    split = docs.select(
        key,
        op.is_validation(F.col(key), config.validation_fraction, config.seed).alias("is_validation"),
        n_chars.cast("bigint").alias("n_chars"),
        text,
    )
    bound = op.buffer_size(config.seq_length, config.chars_per_token, config.sequences_per_buffer)
    sharded = op.assign_shards(split, key, "n_chars", bound, by=("is_validation",))
    permuted = op.fim_permute(
        regex_tokens(F.col(text), token_pattern), F.col(key),
        fim_rate=config.fim_rate, fim_spm_rate=config.fim_spm_rate, seed=config.seed,
    )
    ready = sharded.select("is_validation", "shard", key, permuted["tokens"].alias("tokens"))
    packed = op.pack_constant_length(
        ready, key, "tokens", config.seq_length, by=("is_validation", "shard"), bounded=True
    )
    if not ranked:
        return packed
    # Counted and ranked from what is stored; labels repeat input_ids, so they are added behind the shuffle.
    packed = checkpointed(packed.drop("labels"), "pieces")
    draw = draw_bits("shuffle", F.lit(0), F.col("shard"), F.col("piece"), seed=config.seed)
    drawn = packed.withColumns({"__bits": draw, "__tie": F.struct("shard", "piece")})
    shuffled = random_rank(drawn, "__bits", "__tie", "rank", by=("is_validation",))
    return shuffled.drop("__bits", "__tie").withColumn("labels", F.col("input_ids"))


def measured_ratio(docs: DataFrame, key: str, text: str, config: TrainingConfig, token_pattern: str) -> float:
    """Characters per token of the first training rows; ``config.chars_per_token`` when they have no tokens."""
    train = docs.where(~op.is_validation(F.col(key), config.validation_fraction, config.seed))
    found = op.chars_token_ratio(train, key, text, pattern=token_pattern).first()["chars_per_token"]
    return found or config.chars_per_token


def prepare_epochs(
    docs: DataFrame,
    key: str,
    text: str,
    epochs: int,
    config: TrainingConfig = TrainingConfig(),
    token_pattern: str = CODE_TOKEN,
) -> DataFrame:
    """(epoch, is_validation, shard, piece, position, input_ids, labels): training repeats, validation does not.

    Every epoch draws the fill-in-the-middle permutation anew and has an order of its own; ``position`` is the place
    in the order of its split and epoch. The ratio of characters to tokens that bounds the shards is measured on the
    first training rows. Texts are cut into tokens once; pieces are stored once, and their places come from
    the counts of the shards and a keyed permutation, without a sort. Validation rows have epoch 0 only.
    """
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.length(text)
    held = op.is_validation(F.col(key), config.validation_fraction, config.seed).alias("is_validation")
    split = docs.select(key, held, n_chars.cast("bigint").alias("n_chars"))
    ratio = measured_ratio(docs, key, text, config, token_pattern)
    bound = op.buffer_size(config.seq_length, ratio, config.sequences_per_buffer)
    # Keys and sizes alone are placed; the texts meet their shard afterwards.
    sharded = op.assign_shards(split, key, "n_chars", bound, by=("is_validation",)).drop("n_chars")
    texts = docs.select(key, F.col(text).alias("text")).join(sharded, key)
    # A shard has a limited size, so it becomes one row: only its texts pass a shuffle, once for all epochs.
    rows = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "text")))
    shards = texts.groupBy("is_validation", "shard").agg(rows.alias("docs"))
    cut = F.transform(
        "docs", lambda d: F.struct(d["key"].alias("key"), regex_tokens(d["text"], token_pattern).alias("tokens"))
    )
    repeats = F.when(F.col("is_validation"), 1).otherwise(epochs)
    numbers = F.sequence(F.lit(0), repeats - 1)
    tokens = shards.select("is_validation", "shard", cut.alias("docs"))
    each = explode_once(tokens, numbers, "is_validation", "shard", "docs", value="epoch").drop("pos")

    def ended(doc: Column) -> Column:
        permuted = op.fim_permute(
            doc["tokens"], F.col("epoch"), doc["key"],
            fim_rate=config.fim_rate, fim_spm_rate=config.fim_spm_rate, seed=config.seed,
        )
        return F.concat(permuted["tokens"], F.array(F.lit(op.EOS)))

    by = ("epoch", "is_validation", "shard")
    joined = F.flatten(F.filter(F.transform("docs", ended), lambda t: t.isNotNull()))
    packed = op.whole_pieces(each.select(*by, joined.alias("tokens")), "tokens", config.seq_length, by)
    pieces = checkpointed(packed, "pieces")
    counts = checkpointed(pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    bases = running_total(counts, "shard", "n", "__base", by=("epoch", "is_validation")).drop("n")
    bases = F.broadcast(bases) if counts.count() <= MOST_BROADCAST_SHARDS else bases
    ranked = pieces.join(bases, [*by]).withColumn("__rank", F.col("__base") + F.col("piece"))
    # One row per epoch and split.
    totals = counts.groupBy("epoch", "is_validation").agg(F.sum("n").alias("n")).collect()
    placed = None
    for row in sorted(totals, key=lambda r: (r["epoch"], r["is_validation"])):
        own = ranked.where((F.col("epoch") == row["epoch"]) & (F.col("is_validation") == row["is_validation"]))
        salted = op.epoch_positions(own, "__rank", row["n"], seed=config.seed)
        placed = salted if placed is None else placed.unionByName(salted)
    if placed is None:
        placed = ranked.withColumn("position", F.col("__rank"))
    return placed.drop("__rank", "__base").withColumn("labels", F.col("input_ids"))
