"""Documents, tasks, snippets, stored results, questions and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import files as fn
from corpusloom.functions import text
from corpusloom.operators.prefix import starts_in_order
from corpusloom.sources.filetree import list_files, read_contents, scan_files


def read_text_document(spark: SparkSession, path: str) -> DataFrame:
    """(source, content): a file, or every file below a folder, as one document.

    Unlike the built-in text reader this reads files whose names begin with '_' or '.'.
    """
    return read_contents(list_files(spark, path)).select(F.col("path").alias("source"), "content")


def read_source_tree(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """All files with a suffix, without any ignore rule."""
    return scan_files(
        spark, root, ignored_dir_regex=None, ignored_file_regex=rf"(?!.*{_escaped(suffix)}$)",
        skip_hidden_dirs=False,
    )


def _escaped(suffix: str) -> str:
    return suffix.replace(".", r"\.")


def read_corpus(
    spark: SparkSession, path: str, lang: str, streaming: bool = False, text_col: str = "content"
) -> DataFrame:
    """Rows of one language of a corpus partitioned by ``lang``; other partitions are not read."""
    if streaming:
        schema = spark.read.parquet(path).schema
        df = spark.readStream.schema(schema).parquet(path)
    else:
        df = spark.read.parquet(path)
    return df.where((F.col("lang") == lang) & F.col(text_col).isNotNull())


def _named_files(spark: SparkSession, root: str) -> DataFrame:
    return read_contents(list_files(spark, root)).withColumn("name", fn.base_name(F.col("path")))


def read_completion_tasks(
    spark: SparkSession, root: str, lang: str, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(tasks, errors) from the files below ``root/lang``; the file name is the name of the task.

    A file without placeholder goes to ``errors`` (task_name, error), or fails the job when ``strict``.
    """
    found = _named_files(spark, f"{root.rstrip('/')}/{lang}").select(
        F.col("name").alias("task_name"), F.lit(lang).alias("lang_id"), F.col("content").alias("code")
    )
    usable = F.lit(True) if strict else text.has_placeholder(F.col("code"))
    tasks = found.where(usable).withColumn("p", text.split_placeholder(F.col("code"), strict))
    errors = found.where(~text.has_placeholder(F.col("code")))
    return (
        tasks.select("task_name", "lang_id", "p.prefix", "p.suffix"),
        errors.select("task_name", F.lit("no placeholder").alias("error")),
    )


def read_snippets(spark: SparkSession, root: str) -> DataFrame:
    """(snippet_name, code): one row per file."""
    return _named_files(spark, root).select(
        F.col("name").alias("snippet_name"), F.col("content").alias("code")
    )


def read_stored_completions(spark: SparkSession, root: str) -> DataFrame:
    """(task_name, base_name, content) from ``root/<task>/<file>``, ready for ``stored_results``."""
    parts = F.split("rel_path", "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    files = list_files(spark, root).where(F.size(parts) == 2)
    return read_contents(files).select(
        F.element_at(parts, 1).alias("task_name"), stem.alias("base_name"), "content"
    )


def number_questions(questions: DataFrame, question: str, *order: str) -> DataFrame:
    """(query_id, question) of a table of questions, numbered from 0 in the order of columns of any type."""
    one = questions.select(*order, F.col(question).alias("question"), F.lit(1).cast("bigint").alias("__one"))
    return starts_in_order(one, list(order), "__one", "query_id").select("query_id", "question")


def read_questions(spark: SparkSession, questions: list[str]) -> DataFrame:
    """(query_id, question) of a list of questions."""
    return spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")
