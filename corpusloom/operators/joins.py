"""Joins that hold when single keys carry a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it has more than one HOT_SHARE-th of the sampled rows, so there are fewer than
# HOT_SHARE hot keys. That bound is what makes their broadcast safe at any data size.
HOT_SHARE = 1000
HOT_MIN_SAMPLED = 1000
SAMPLE = 0.01


def hot_keys(
    df: DataFrame, on: str, sample: float = SAMPLE, min_sampled: int = HOT_MIN_SAMPLED
) -> DataFrame:
    """Keys that hold a large share of the rows, by a sample. They steer the plan, not the result."""
    counts = df.select(on).sample(sample, seed=0).groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.where((F.col("__n") >= min_sampled) & (F.col("__n") * HOT_SHARE > total)).select(on)


def skew_safe_lookup(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per ``on``.

    Rows with hot keys find their partner in a broadcast of the few matching right rows. They pass
    the ordinary join under keys of their own, which spread evenly over its partitions.
    """
    added = [c for c in right.columns if c != on]
    hot = hot_keys(left, on) if hot is None else hot
    near = right.join(F.broadcast(hot), on, "left_semi").select(on, F.struct(*added).alias("__near"))
    far = right.select(
        F.lit(0).cast("bigint").alias("__s"), F.col(on).alias("__k"), F.struct(*added).alias("__far")
    )
    marked = left.join(F.broadcast(near), on, "left")
    # rows that need no partner have a null key, which matches nothing, and are spread by their salt
    needs = F.col("__near").isNull() & F.col(on).isNotNull()
    salted = marked.withColumn("__s", F.when(needs, 0).otherwise(F.xxhash64(*left.columns))).withColumn(
        "__k", F.when(needs, F.col(on))
    )
    found = salted.join(far, ["__s", "__k"], "left").withColumn("__hit", F.coalesce("__near", "__far"))
    if how == "inner":
        found = found.where(F.col("__hit").isNotNull())
    return found.select(*left.columns, *[F.col(f"__hit.{c}").alias(c) for c in added])


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from ``left``."""
    names = {c: f"__right_{c}" for c in on}
    renamed = right.withColumnsRenamed(names)
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(renamed[names[c]])
    return left.join(renamed, same, how).drop(*names.values())


def unseen(new: DataFrame, stored: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet. Only the key of ``stored`` is read."""
    keys = [on] if isinstance(on, str) else on
    return new.join(stored.select(*keys), keys, "left_anti")
