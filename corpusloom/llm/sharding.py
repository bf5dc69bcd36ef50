"""Contiguous shards of nearly equal size.

Every row has a size, the UTF-8 bytes of its text and a fixed cost. Rows are ordered by a key; ranges of the
order sum their own rows, the totals of the ranges give each range its base, and base plus local sum is the
number of bytes before a row (``operators.prefix.ordered_totals``). A row belongs to the shard that the middle
of its bytes falls into when all bytes are cut into equal parts, so every border lies at the end of the row
nearest to its target, and a shard differs from the equal part by at most the size of the largest row. A row
larger than a part may leave shards empty.

Only key, size and checksum are moved, never a text. All of it is SQL functions.

A null text has no bytes and still its fixed cost; its checksum is 0, as that of the empty text. Null keys
come first. Rows with equal keys are ordered by checksum and size; rows alike in all three are interchangeable and
may be cut apart, so a text or key with most of the rows is spread like any other. An empty table gives no
rows. Columns of the table other than key and text play no part; a key named size, text_crc32, shard or slot is
refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import ordered_totals
from corpusloom.session import checkpointed

SHARDS = 24
#: Bytes that a row costs beside its text.
ROW_COST = 8
ADDED = ("size", "text_crc32", "shard", "slot")


def sized(docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Key, size and checksum of every row."""
    if clash := [k for k in key if k.lower() in ADDED]:
        raise ValueError(f"rename the key columns {clash}")
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        *key,
        (F.octet_length(content) + F.lit(ROW_COST)).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )


def balanced_shards(
    docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """Key, size, text_crc32, shard (from 0) and slot (from 0 without gaps in its shard) of every row."""
    rows = sized(docs, key, text).withColumn("__one", F.lit(1).cast("bigint"))
    order = [*key, "text_crc32", "size"]
    placed = ordered_totals(rows, order, {"__bytes": "size", "__rows": "__one"})
    # Stored because the shards' first rows and the rows themselves both come from it.
    placed = checkpointed(placed.drop("__one"), "placed")
    total = placed.agg(F.max(F.col("__bytes") + F.col("size"))).scalar()
    middle = (2 * F.col("__bytes") + F.col("size")).cast("decimal(30,0)") * shards
    shard = F.floor(middle / (2 * F.coalesce(total, F.lit(1)))).cast("int")
    dealt = placed.withColumn("shard", shard)
    firsts = dealt.groupBy("shard").agg(F.min("__rows").alias("__first"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        *key, "size", "text_crc32", "shard", (F.col("__rows") - F.col("__first")).alias("slot")
    )


def shard_bounds(placed: DataFrame, key: Sequence[str] = ("doc_id",)) -> list[tuple[int, tuple]]:
    """(shard, smallest key) of every shard that has rows; one row per shard reaches the driver."""
    least = F.min(F.struct(*key)).alias("least")
    rows = placed.groupBy("shard").agg(least).orderBy("shard").collect()
    return [(r["shard"], tuple(r["least"])) for r in rows]


def write_shards(
    docs: DataFrame, bounds: Sequence[tuple[int, tuple]], path: str, key: Sequence[str] = ("doc_id",)
) -> None:
    """Write whole rows as folders ``shard=N`` by the bounds: no join and no exchange, one comparison per shard.

    Rows with equal keys stay together, in the first of the shards that hold the key; bounds of a shard that
    begins with the key of the one before leave it empty.
    """
    schema = docs.select(F.struct(*key).alias("k")).schema["k"].dataType
    own = F.struct(*key).cast(schema)
    shard: Column = F.lit(bounds[0][0] if bounds else 0)
    for (number, least), (_, previous) in zip(bounds[1:], bounds, strict=False):
        start = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(least, schema, strict=True)])
        # A key that began in an earlier shard stays there.
        if least != previous:
            shard = F.when(own >= start.cast(schema), F.lit(number)).otherwise(shard)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
