"""Vector tables, embedding caches, results and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import join_placeholder, model_id_to_fn
from corpusloom.operators import completions as op
from corpusloom.operators.embedding import CACHE_SCHEMA
from corpusloom.operators.joins import unseen
from corpusloom.operators.training import shuffle_rows
from corpusloom.session import checkpointed, shuffles_dropped
from corpusloom.sources.filetree import write_files


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is there a Parquet table? Only a missing or empty folder counts as none; other errors are raised."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def write_vector_table(rows: DataFrame, path: str, reset: bool = True, key: str = "doc_id") -> None:
    """Write (doc_id, content, embedding, …). ``reset`` replaces the table; otherwise only rows with
    unseen ids are added. Ids contain time and size of a file, so a changed file is new."""
    if reset:
        rows.write.mode("overwrite").parquet(path)
    elif not table_exists(rows.sparkSession, path):
        rows.write.mode("append").parquet(path)
    else:
        stored = rows.sparkSession.read.parquet(path)
        unseen(rows, stored, key).write.mode("append").parquet(path)


def load_or_create(rows: DataFrame, path: str) -> DataFrame:
    """The stored table if there is one, otherwise the given rows, stored."""
    if not table_exists(rows.sparkSession, path):
        rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def load_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty when there is none yet."""
    if table_exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def save_embedding_cache(misses: DataFrame, path: str) -> None:
    """Add new vectors to the cache. Commit this before the vector table: vectors are the costly part."""
    with shuffles_dropped(misses.sparkSession):
        misses.write.mode("append").partitionBy("model").parquet(path)


def write_results(completions: DataFrame, out: str) -> None:
    """Files ``<lang>/<task>/task<ext>`` and ``<lang>/<task>/<model><ext>`` below ``out``.

    ``completions`` has (lang_id, task_name, prefix, suffix, model_id, full_code).
    """
    ext = F.regexp_extract("task_name", r"^.+(\.[^.]*)$", 1)
    folder = F.concat("lang_id", F.lit("/"), "task_name", F.lit("/"))

    def task_files(rows: DataFrame) -> DataFrame:
        content = join_placeholder(F.col("prefix"), F.col("suffix")).alias("content")
        return rows.select(F.concat(folder, F.lit("task"), ext).alias("rel_path"), content)

    answers = completions.select(
        F.concat(folder, model_id_to_fn(F.col("model_id")), ext).alias("rel_path"),
        F.col("full_code").alias("content"),
    )
    # A task is written with the answer of the first model. Only tasks without one meet in a shuffle with their texts.
    keys = ["lang_id", "task_name"]
    first = F.coalesce(F.col("model_id") == completions.agg(F.min("model_id")).scalar(), F.lit(False))
    without = completions.groupBy(*keys).agg(F.max(first).alias("has")).where(~F.col("has")).select(*keys)
    late = completions.join(checkpointed(without, "without"), keys, "left_semi")
    tasks = task_files(completions.where(first)).unionByName(task_files(late).dropDuplicates(["rel_path"]))
    write_files(tasks.unionByName(answers), out)


def write_html_report(
    completions: DataFrame, out: str, columns: int = op.REPORT_COLUMNS, compression: str = "none"
) -> None:
    """One folder per language; its part files in name order are the page, plain or compressed (``gzip``).

    A page has the text of a task once more for every model, so compressed it is a small part of it.

    Start, one fragment per task, and end of a page are rows of one ordered table, so a page of any
    number of tasks is written by many tasks.
    """
    langs = completions.select("lang_id").distinct()

    def edge(place: int, html: Column) -> DataFrame:
        return langs.select("lang_id", F.lit(place).alias("place"), F.lit("").alias("task_name"), html.alias("edge"))

    order = ["lang_id", "place", "task_name"]
    rows = completions.withColumn("place", F.lit(1)).withColumn("edge", F.lit(None).cast("string"))
    edges = edge(0, op.page_start(F.col("lang_id"))).unionByName(edge(2, F.lit(op.PAGE_END)))
    # The ranges of the page serve the grouping by task as well: one shuffle brings the texts.
    ranged = rows.unionByName(edges, allowMissingColumns=True).repartitionByRange(*order)
    page = op.report_fragments(ranged, columns, by=("place", "edge"))
    ordered = page.withColumn("html", F.coalesce("edge", "html")).sortWithinPartitions(*order)
    with shuffles_dropped(completions.sparkSession):
        ordered.select("lang_id", "html").write.mode("overwrite").partitionBy("lang_id").text(out, compression=compression)


def write_sequences(sequences: DataFrame, out: str, seed: int = 0, epoch: int = 0) -> None:
    """Training sequences as Parquet, in shuffled order within each split."""
    shuffled = shuffle_rows(sequences, "shard", "piece", seed=seed, epoch=epoch)
    shuffled.write.mode("overwrite").partitionBy("is_validation").parquet(out)
