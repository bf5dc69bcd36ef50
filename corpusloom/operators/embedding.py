"""Embedding through a persistent cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import embedding_key
from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators.joins import skew_safe_lookup, unseen

CACHE_SCHEMA = "model string, text_key string, text string, embedding array<float>"

Embedder = Callable[[Column], Column]


def text_key(text: Column) -> Column:
    """128-bit key of the normalised text: heavy text stays out of the joins."""
    return F.md5(embedding_key(text))


def cache_misses(
    texts: DataFrame,
    cache: DataFrame,
    model: str,
    embedder: Embedder = hash_embedding,
    text: str = "text",
) -> DataFrame:
    """Rows to add to the cache: each new text once, however often it occurs.

    Keys are made distinct first, with partial results on the map side, so a text that makes up a
    third of the rows is one row per task before the shuffle.
    """
    distinct = (
        texts.select(text_key(F.col(text)).alias("text_key"), embedding_key(F.col(text)).alias("text"))
        .dropDuplicates(["text_key"])
    )
    known = cache.where(F.col("model") == model)
    return unseen(distinct, known, "text_key").select(
        F.lit(model).alias("model"), "text_key", "text", embedder(F.col("text")).alias("embedding")
    )


def attach_embeddings(
    texts: DataFrame, cache: DataFrame, model: str, text: str = "text"
) -> DataFrame:
    """Add ``embedding`` from a cache that covers all texts; a text that it does not hold fails the job.

    A null text has a null embedding.
    """
    vectors = cache.where(F.col("model") == model).select("text_key", "embedding")
    keyed = texts.withColumn("text_key", text_key(F.col(text)))
    found = skew_safe_lookup(keyed, vectors, "text_key", "left")
    missing = F.raise_error(F.concat(F.lit("no embedding for text "), F.col("text_key"))).cast("array<float>")
    checked = F.when(F.col("text_key").isNotNull() & F.col("embedding").isNull(), missing).otherwise(F.col("embedding"))
    return found.withColumn("embedding", checked).drop("text_key")


def embed_with_cache(
    texts: DataFrame,
    cache: DataFrame,
    model: str,
    embedder: Embedder = hash_embedding,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(texts with ``embedding``, rows to add to the cache).

    To compute each vector once, write the second frame to the cache and use
    :func:`attach_embeddings` on the table; that is what the indexing plan does.
    """
    misses = cache_misses(texts, cache, model, embedder, text)
    full = cache.where(F.col("model") == model).unionByName(misses)
    return attach_embeddings(texts, full, model, text), misses
