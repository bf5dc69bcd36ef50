"""Exact order statistics of many groups at once, by radix selection.

A number becomes 64 bits whose order as a signed integer is the order of the numbers. A round counts, for all
groups together, the rows by the next 16 bits among those that share the bits found so far, and finds in which
count the wanted rank lies; after four rounds one value is left. A task holds counts, never values: a window has at
most 65,536 rows per group and value searched, however large the group is and however close its values are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.joins import null_safe_join
from corpusloom.session import checkpointed

DIGIT = 16
BITS = 64
#: Groups times ranks whose state is broadcast; more are joined by a shuffle, with adaptive skew handling.
MOST_BROADCAST = 100_000

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@F.pandas_udf(T.LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; -0.0 is 0.0, and NaN comes after everything."""
    x = values.to_numpy(dtype=np.float64, na_value=np.nan) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    # Of negative numbers the larger magnitude comes first.
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), index=values.index)


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(dtype=np.int64, na_value=0)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64), index=bits.index)


def discrete_rank(q: float, n: Column) -> Column:
    """The rank (from 1) of the discrete quantile ``q``: the first one with a share of q of the rows up to it."""
    return F.greatest(F.ceil(F.round(F.lit(q) * n, 9)), F.lit(1)).cast("bigint")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """(by…, name, value): for each group and each named rank, the value at that place.

    A rank is an expression of ``n``, the number of values of a group that are not null, and counts from 1. A group
    without values has nulls. Null group keys are a group. Integers stay integers, other numbers are doubles.
    """
    exact = isinstance(df.schema[value].dataType, INTEGERS)
    bits = F.col(value).cast("bigint") if exact else ordered_bits(F.col(value).cast("double"))
    # Four rounds read it.
    rows = checkpointed(
        df.select(*by, F.when(F.col(value).isNotNull(), bits).alias("__bits")), "ordered-bits"
    )
    sizes = rows.groupBy(*by).agg(F.count("__bits").alias("n"))
    names = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])
    wanted = sizes.select(*by, "n", F.explode(names).alias("w")).select(
        *by, "w.name", (F.col("w.rank") - 1).alias("__rank"),
        F.when(F.col("n") > 0, F.lit(0).cast("bigint")).alias("__found"),
    )
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        wanted = _narrowed(rows, wanted, list(by), shift)
    out = F.col("__found") if exact else from_ordered_bits("__found")
    return wanted.select(*by, "name", F.when(F.col("__found").isNotNull(), out).alias(value))


def _narrowed(rows: DataFrame, wanted: DataFrame, by: list[str], shift: int) -> DataFrame:
    """One round: the bits above ``shift`` of each wanted value, and its rank among the rows that share them."""
    wanted = checkpointed(wanted, "wanted")
    few = wanted.count() <= MOST_BROADCAST
    # Above the first digit there is nothing to share.
    known = F.shiftright("__bits", shift + DIGIT) if shift + DIGIT < BITS else F.lit(0).cast("bigint")
    searched = wanted.where(F.col("__found").isNotNull()).select(*by, "__found").distinct()
    placed = rows.where(F.col("__bits").isNotNull()).withColumn("__found", known)
    held = null_safe_join(placed, F.broadcast(searched) if few else searched, [*by, "__found"])
    counts = held.groupBy(*by, "__found", F.shiftright("__bits", shift).alias("__next")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy(*by, "__found").orderBy("__next").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    met = null_safe_join(summed, F.broadcast(wanted) if few else wanted, [*by, "__found"])
    here = (F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__n"))
    found = met.where(here).select(
        *by, "name", (F.col("__rank") - F.col("__before")).alias("__rank"), F.col("__next").alias("__found")
    )
    return found.unionByName(wanted.where(F.col("__found").isNull()))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """(by…, quantile, value): discrete quantiles, values that occur."""
    ranks = {repr(float(q)): discrete_rank(q, F.col("n")) for q in quantiles}
    found = order_statistics(df, by, value, ranks)
    return found.select(*by, F.col("name").cast("double").alias("quantile"), value)


def radix_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by…, median): the mean of the two middle values; groups without values are left out."""
    n = F.col("n")
    middle = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1}
    found = order_statistics(df, by, value, middle).where(F.col(value).isNotNull())
    return found.groupBy(*by).agg((F.sum(F.col(value).cast("double")) / 2).alias("median"))
