"""Running totals over a whole table without a single-partition window.

Rows are grouped by the high bits of their (unique) integer order key. Totals of the groups are
grouped again by higher bits, and so on: every window partition holds at most ``2**RADIX_BITS``
rows by construction, however the keys are spread, and each level is that many times smaller than
the one below.

Keys of any orderable type (texts, several columns, repeated keys) go through ``ordered_totals``:
sampled splitters cut the order into ranges, each range sums its own rows, and the totals of the
ranges give every range its base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import null_safe_join
from corpusloom.session import checkpointed

RADIX_BITS = 12
#: Rows that one range of ``ordered_totals`` should hold at most, and at least where there are few.
MOST_IN_RANGE = 500_000
LEAST_IN_RANGE = 2_000
#: Ranges whose bases are broadcast (32 bytes each); more are joined by a shuffle.
MOST_BROADCAST_RANGES = 100_000


def _key_range(df: DataFrame, key: str) -> tuple[int, int]:
    """(smallest key, levels): one narrow aggregate, answered from file footers where possible."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return 0, 1
    return low, max(1, -(-(high - low).bit_length() // RADIX_BITS))


def running_total(
    df: DataFrame, key: str, amount: str, out: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``out`` = sum of ``amount`` over all rows with a smaller ``key`` (within ``by``).

    ``key`` is an integer column, unique within ``by``.
    """
    low, levels = _key_range(df, key)
    return _running_total(df, key, low, amount, out, by, levels)


def _running_total(
    df: DataFrame, key: str, low: int, amount: str, out: str, by: tuple[str, ...], levels: int
) -> DataFrame:
    group = f"__{out}_group"
    grouped = df.withColumn(
        group, F.shiftright(F.col(key).cast("bigint") - F.lit(low).cast("bigint"), RADIX_BITS)
    )
    inside = Window.partitionBy(*by, group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    if levels <= 1:
        return grouped.withColumn(out, local).drop(group)

    base = f"__{out}_base"
    totals = grouped.groupBy(*by, group).agg(F.sum(amount).alias(amount))
    offsets = _running_total(totals, group, 0, amount, base, by, levels - 1).drop(amount)
    return (
        grouped.withColumn(out, local)
        .transform(null_safe_join, offsets, [*by, group], "left")
        .withColumn(out, F.col(out) + F.col(base))
        .drop(group, base)
    )


def _with_bucket_base(
    df: DataFrame, bits: str, bucket: str, by: tuple[str, ...], bucket_bits: int
) -> tuple[DataFrame, DataFrame]:
    bucketed = df.withColumn(bucket, F.shiftright(F.col(bits), 32 - bucket_bits))
    counts = bucketed.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return bucketed, bases


def random_rank(
    df: DataFrame,
    bits: str,
    ties: str,
    out: str,
    by: tuple[str, ...] = (),
    bucket_bits: int = RADIX_BITS,
) -> DataFrame:
    """Add the 0-based rank by (``bits``, ``ties``), where ``bits`` are 32 uniform random bits.

    Uniform bits spread evenly over ``2**bucket_bits`` buckets, so a window per bucket is small
    and only the bucket counts, one row each, are summed over the whole table.
    """
    bucketed, bases = _with_bucket_base(df, bits, "__bucket", by, bucket_bits)
    inside = Window.partitionBy(*by, "__bucket").orderBy(bits, ties)
    return (
        bucketed.withColumn(out, (F.row_number().over(inside) - 1).cast("bigint"))
        # every bucket has a base; a left join keeps null checks on the draw out of the input
        .transform(null_safe_join, bases, [*by, "__bucket"], "left")
        .withColumn(out, F.col(out) + F.col("__base"))
        .drop("__bucket", "__n", "__base")
    )




def ordered_totals(
    df: DataFrame,
    order: Sequence[str],
    amounts: dict[str, str],
    most_in_range: int = MOST_IN_RANGE,
    row: str | None = None,
) -> DataFrame:
    """``df`` with, for each ``out: amount``, the sum of ``amount`` over all rows before it in the order.

    ``order`` names columns of any orderable type; nulls come first. Rows alike in all of them are told
    apart by where the scan found them, so a key with most of the rows is cut into ranges like any other.
    Null amounts count as 0. All columns of ``df`` pass two exchanges, so it should be narrow: keys and
    amounts; wide columns join in later (``starts_in_order``). Ranges come from Spark's sampled splitters, which
    changes where they are cut but not the result. ``row`` names a unique number of rows that are stored
    already; without it they are stored with one.
    """
    cut = "__range"
    if row:
        rows = df
    else:
        row = "__row"
        rows = checkpointed(df.withColumn(row, F.monotonically_increasing_id()), "ordered")
    n = rows.count()
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-n // most_in_range), min(spread, n // LEAST_IN_RANGE))
    # The ranges are stored: two plans that dealt the rows by themselves might cut them differently.
    ranged = checkpointed(
        rows.repartitionByRange(ranges, *order, row).withColumn(cut, F.spark_partition_id()), "ranges"
    )
    totals = ranged.groupBy(cut).agg(*[F.sum(F.coalesce(a, F.lit(0))).alias(out) for out, a in amounts.items()])
    levels = max(1, -(-ranges.bit_length() // RADIX_BITS))
    bases = totals
    for out in amounts:
        base = _running_total(totals.select(cut, out), cut, 0, out, f"__base_{out}", (), levels)
        bases = bases.join(base.select(cut, f"__base_{out}"), cut)
    bases = bases.drop(*amounts)
    before = Window.partitionBy(cut).orderBy(*order, row).rowsBetween(Window.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(F.coalesce(a, F.lit(0))).over(before), F.lit(0)).alias(out) for out, a in amounts.items()]
    summed = ranged.select("*", *local)
    placed = summed.join(F.broadcast(bases) if ranges <= MOST_BROADCAST_RANGES else bases, cut)
    whole = {out: F.col(out) + F.col(f"__base_{out}") for out in amounts}
    return placed.withColumns(whole).select(*df.columns, *amounts)


def starts_in_order(df: DataFrame, order: Sequence[str], amount: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over all rows before it in the order.

    The table is stored once with a number for every row. Order, amount and number alone pass the exchanges and
    windows of ``ordered_totals``; the result comes back to the wide rows by their number, in one join.
    """
    number = "__number"
    rows = checkpointed(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    placed = ordered_totals(rows.select(number, *order, amount), order, {out: amount}, row=number)
    return rows.join(placed.select(number, out), number).drop(number)
