"""Corpora and indexes that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators.embedding import Embedder
from corpusloom.operators.training import is_validation, shuffle_rows
from corpusloom.plans.indexing import chunks_of, store_chunks
from corpusloom.sources import versions


def index_stream(
    files: DataFrame,
    table_path: str,
    cache_path: str,
    checkpoint: str,
    model: str = "hash-64",
    embedder: Embedder = hash_embedding,
    **sizes: int,
) -> StreamingQuery:
    """Keep a vector table up to date with a stream of scanned files.

    Every micro-batch adds the chunks with unseen ids, so a batch that is run again after a failure
    adds nothing twice.
    """

    def add(batch: DataFrame, _batch_id: int) -> None:
        chunks, _errors = chunks_of(batch, **sizes)
        store_chunks(chunks, table_path, cache_path, model, embedder, reset=False)

    return (
        files.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_changes_stream(
    changes: DataFrame,
    table: str,
    cache_path: str,
    checkpoint: str,
    model: str = "hash-64",
    embedder: Embedder = hash_embedding,
    **sizes: int,
) -> StreamingQuery:
    """Keep a versioned vector table up to date with a stream of changed and vanished files.

    The number of a micro-batch is that of the stream's checkpoint, so one that runs again replaces what it wrote.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        versions.apply_changes(batch, table, batch_id, cache_path, model, embedder, **sizes)

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def corpus_stream(
    rows: DataFrame,
    key: str,
    out: str,
    fraction: float,
    checkpoint: str,
    seed: int = 0,
) -> StreamingQuery:
    """Split a stream of corpus rows and write each micro-batch shuffled, below ``is_validation``.

    The split depends on the row key only: no count of rows is kept, and the rows are the same as
    in a batch run. ``checkpoint`` belongs to ``out``: with another one batch numbers would begin again.
    """
    split = rows.withColumn("is_validation", is_validation(F.col(key), fraction, seed))

    def write(batch: DataFrame, batch_id: int) -> None:
        # a folder of its own per micro-batch: running it again replaces it
        shuffled = shuffle_rows(batch, key, seed=seed, epoch=batch_id)
        shuffled.write.mode("overwrite").partitionBy("is_validation").parquet(f"{out}/batch={batch_id}")

    return (
        split.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
