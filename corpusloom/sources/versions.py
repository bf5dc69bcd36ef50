"""A vector table that follows changes of its files.

Every micro-batch adds two folders named by its number: ``chunks`` with the chunks of the files it brought, and
``files`` with one row per file version, or a tombstone for a file that is gone. The second is written last and
commits the first. A batch that runs again replaces what it wrote, so each counts exactly once.

The current version of a path is its newest one by time, then number of the batch, whatever the order in which the
batches came. Compaction writes the current versions as a new generation and commits it by a row; batches that
it holds are not taken again, and readers change over to the newest committed generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators.embedding import Embedder, attach_embeddings, cache_misses
from corpusloom.plans.indexing import chunks_of
from corpusloom.session import checkpointed, passing, shuffles_dropped
from corpusloom.sources import tables

FILES_SCHEMA = "path string, version timestamp, gone boolean, batch bigint"
ERRORS_SCHEMA = "path string, error string"


def _generation(spark: SparkSession, table: str) -> tuple[int, int]:
    """(number of the committed generation, largest batch it holds); (0, -1) before any compaction."""
    if not tables.table_exists(spark, f"{table}/generations"):
        return 0, -1
    row = spark.read.parquet(f"{table}/generations").orderBy(F.desc("generation")).first()
    return row["generation"], row["upto"]


def _folder(table: str, kind: str, generation: int) -> str:
    return f"{table}/{kind}/generation={generation}"


def _write_batch(df: DataFrame, table: str, kind: str, generation: int, batch: int) -> None:
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(f"{_folder(table, kind, generation)}/batch={batch}")


def versions(spark: SparkSession, table: str) -> DataFrame:
    """(path, version, gone, batch): every committed version of the current generation."""
    folder = _folder(table, "files", _generation(spark, table)[0])
    if not tables.table_exists(spark, folder):
        return spark.createDataFrame([], FILES_SCHEMA)
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").select(
        "path", "version", "gone", F.col("batch").cast("bigint").alias("batch")
    )


def current_files(spark: SparkSession, table: str) -> DataFrame:
    """(path, version, batch) of the newest version of every path that is not gone."""
    newest = F.max(F.struct("version", "batch", "gone")).alias("n")
    live = versions(spark, table).groupBy("path").agg(newest).where(~F.col("n.gone"))
    return live.select("path", "n.version", "n.batch")


def current_chunks(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of all current files, with their vectors. The join is by path; a path's chunks may be many, but
    each file version is one row on the other side."""
    generation, _ = _generation(spark, table)
    folder = _folder(table, "chunks", generation)
    if not tables.table_exists(spark, folder):
        raise ValueError(f"nothing is stored in {table}")
    # Chunks of a batch that was not committed have no version that names the batch.
    chunks = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    chunks = chunks.withColumn("batch", F.col("batch").cast("bigint"))
    live = current_files(spark, table).withColumnRenamed("version", "last_modified")
    return chunks.join(live, ["path", "last_modified", "batch"], "left_semi").drop("batch")


def apply_changes(
    changed: DataFrame,
    table: str,
    batch: int,
    cache_path: str,
    model: str = "hash-64",
    embedder: Embedder = hash_embedding,
    **sizes: int,
) -> DataFrame:
    """Add one micro-batch of changed files; gives the files that could not be split, with the reason.

    ``changed`` has what a scan gives (path, extension, size, line_count, last_modified, content) and may have
    ``gone``, true for a file that vanished at ``last_modified``. Of several versions of a path only the newest is
    split and embedded; of equal ones any. A file that cannot be split replaces its older versions all the same.
    Rows without path or time fail. ``batch`` numbers start at 0; a batch of a number that a compaction already
    holds is left out.
    """
    spark = changed.sparkSession
    generation, upto = _generation(spark, table)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in changed.columns else F.lit(False)
    known = changed.withColumn("gone", gone)
    for name in ("path", "last_modified"):
        absent = F.raise_error(F.lit(f"a changed file without {name}"))
        kept = F.when(F.col(name).isNull(), absent.cast(known.schema[name].dataType)).otherwise(F.col(name))
        known = known.withColumn(name, kept)
    # Contents are read from here, and deleted when the batch has been written.
    with passing(known.withColumn("__row", F.monotonically_increasing_id()), "changed") as stored:
        if batch <= upto:
            return spark.createDataFrame([], ERRORS_SCHEMA)
        # Paths and times meet without the contents. The rows to leave out are few, or as many as the others at worst.
        newest = stored.groupBy("path").agg(F.max(F.struct("last_modified", "gone", "__row")).alias("n"))
        older = stored.select("path", "__row").join(newest, "path").where(F.col("__row") != F.col("n.__row"))
        kept = stored.join(checkpointed(older.select("__row"), "older"), "__row", "left_anti").drop("__row")
        chunks, errors = chunks_of(kept.where(~F.col("gone")), **sizes)
        errors = checkpointed(errors, "errors")
        with passing(chunks, "chunks") as parts:
            cache = tables.load_embedding_cache(spark, cache_path)
            tables.save_embedding_cache(cache_misses(parts, cache, model, embedder, "content"), cache_path)
            rows = attach_embeddings(parts, tables.load_embedding_cache(spark, cache_path), model, "content")
            _write_batch(rows, table, "chunks", generation, batch)
        log = kept.select("path", F.col("last_modified").alias("version"), "gone")
        _write_batch(log, table, "files", generation, batch)
    return errors


def vanished(scanned: DataFrame, table: str, at: str) -> DataFrame:
    """Current paths that a full scan does not hold any more, as tombstones of the time ``at`` for ``apply_changes``."""
    missing = current_files(scanned.sparkSession, table).join(scanned.select("path"), "path", "left_anti")
    filled = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in scanned.schema.fields
        if f.name not in ("path", "last_modified", "gone")
    ]
    time = F.lit(at).cast(scanned.schema["last_modified"].dataType)
    return missing.select("path", *filled, time.alias("last_modified"), F.lit(True).alias("gone"))


def compact(spark: SparkSession, table: str) -> int:
    """Store the current versions as a new generation; gives its number.

    Tombstones stay, as an older version of their path may still come. No batch may be added meanwhile. Run again
    after a failure it starts over, as the generation is committed last.
    """
    generation, _ = _generation(spark, table)
    log = checkpointed(versions(spark, table), "versions")
    upto = log.agg(F.max("batch")).first()[0]
    if upto is None:
        return generation
    newest = log.groupBy("path").agg(F.max(F.struct("version", "batch", "gone")).alias("n"))
    # the folder of another generation is written, so what is read needs no copy
    _write_batch(current_chunks(spark, table), table, "chunks", generation + 1, upto)
    _write_batch(newest.select("path", "n.version", "n.gone"), table, "files", generation + 1, upto)
    done = spark.range(1).select(
        F.lit(generation + 1).cast("bigint").alias("generation"), F.lit(upto).cast("bigint").alias("upto")
    )
    done.write.mode("append").parquet(f"{table}/generations")
    return generation + 1
