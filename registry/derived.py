"""Inputs derived from the driver tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import files as filefn
from corpusloom.functions.common import explode_once, left_of, right_from
from corpusloom.functions.rng import uniform
from corpusloom.functions.text import FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX, PLACEHOLDER
from corpusloom.functions.tokens import STREAM_TOKEN, regex_tokens

MODELS = ["org/base", "runs/ckpt-500", "runs/ckpt-6000"]
TASK_LANG = ["rust", "python", "ruby", "c-sharp", "scala"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, spread: bool = False) -> DataFrame:
    """A driver table. ``spread`` deals a table of few input splits out to all cores.

    Only for work that is heavy per row: a file of a single row group is read by one task. A large
    table has enough splits and is left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*cols) if cols else df
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, df.columns[0])
    return df


def sql_uniform(salt: str, *keys: str, seed: int = 0) -> str:
    joined = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (
        f"(CAST('0x' || substr(md5('{seed}:{salt}:' || {joined}), 1, 8) AS BIGINT) / 4294967296::DOUBLE)"
    )


def sql_bits(salt: str, *keys: str, seed: int = 0) -> str:
    joined = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5('{seed}:{salt}:' || {joined}), 1, 8) AS BIGINT)"


# -- files: documents laid out as a source tree ---------------------------------------------------


def files_table(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", spread=spread)
    doc = F.col("doc_id")
    dirs = F.array(*[F.lit(x) for x in ("src", "data", ".git", "_private", "docs", "database", "lib")])
    exts = F.array(*[F.lit(x) for x in (".py", ".md", ".rb", ".txt", "")])
    stem = F.concat(F.when(doc % 11 == 0, "lock_").otherwise("doc_"), doc.cast("string"))
    path = F.concat(
        F.lit("/corpus/"), F.get(dirs, (doc % 7).cast("int")), F.lit("/"), F.col("source"), F.lit("/"),
        stem, F.get(exts, (doc % 5).cast("int")),
    )
    return d.select(
        "doc_id",
        path.alias("path"),
        F.col("text").alias("content"),
        F.timestamp_add("MINUTE", doc.cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias(
            "last_modified"
        ),
    )


SQL_FILES = """
files AS (
  SELECT doc_id,
    '/corpus/' || (CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'data' WHEN 2 THEN '.git'
        WHEN 3 THEN '_private' WHEN 4 THEN 'docs' WHEN 5 THEN 'database' ELSE 'lib' END)
      || '/' || source || '/'
      || (CASE WHEN doc_id % 11 = 0 THEN 'lock_' ELSE 'doc_' END) || CAST(doc_id AS VARCHAR)
      || (CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.rb' WHEN 3 THEN '.txt'
          ELSE '' END) AS path,
    text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS last_modified
  FROM documents)"""

SQL_KEPT = (
    SQL_FILES
    + """,
kept AS (
  SELECT * FROM files
  WHERE NOT list_has_any(
      list_transform(string_split(path, '/')[1:-2],
        lambda x: starts_with(x, '.') OR regexp_matches(x, '^((_.*)|(data)|(venv)|(env)|(node_modules))')),
      [true])
    AND NOT regexp_matches(string_split(path, '/')[-1], '^.*lock.*'))"""
)


def kept_files(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    df = files_table(spark, sf_dir, spread)
    return df.where(filefn.scan_filter(filefn.relative_path(F.col("path"), "/corpus")))


# -- completion tasks: a placeholder at a random place of each document ---------------------------


def todo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars", spread=True)
    pos = F.floor(uniform("todo", F.col("doc_id")) * (F.col("n_chars") + 1)).cast("int")
    langs = F.array(*[F.lit(x) for x in TASK_LANG])
    return d.select(
        "doc_id",
        F.concat(left_of(F.col("text"), pos), F.lit(PLACEHOLDER), right_from(F.col("text"), pos + 1)).alias(
            "code"
        ),
        F.get(langs, (F.col("doc_id") % 5).cast("int")).alias("lang_id"),
    )


SQL_TODO = f"""
pos AS (
  SELECT doc_id, text, CAST(floor({sql_uniform("todo", "doc_id")} * (n_chars + 1)) AS INTEGER) AS p
  FROM documents),
todo AS (
  SELECT doc_id, substr(text, 1, p) || '{PLACEHOLDER}' || substr(text, p + 1) AS code,
    CASE doc_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'ruby' WHEN 3 THEN 'c-sharp'
      ELSE 'scala' END AS lang_id
  FROM pos)"""

SQL_TASKS = (
    SQL_TODO
    + f""",
tasks AS (
  SELECT doc_id, lang_id, substr(code, 1, instr(code, '{PLACEHOLDER}') - 1) AS prefix,
    substr(code, instr(code, '{PLACEHOLDER}') + {len(PLACEHOLDER)}) AS suffix
  FROM todo)"""
)


def fim_text(prefix: Column, suffix: Column, completion: Column) -> Column:
    return F.concat(
        F.lit(FIM_PREFIX), prefix, F.lit(FIM_SUFFIX), suffix, F.lit(FIM_MIDDLE), completion
    )


# -- fenced text: the rest of a document behind its first line as a code block ---------------------


def fenced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", spread=True)
    p = F.instr("text", "\n")
    fenced = F.concat(
        left_of(F.col("text"), p), F.lit("```python\n"), right_from(F.col("text"), p + 1),
        F.lit("\n```\nEnd."),
    )
    return d.select("doc_id", F.when(p > 0, fenced).otherwise(F.col("text")).alias("fenced"))


SQL_FENCED = """
fenced AS (
  SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0
    THEN substr(text, 1, instr(text, chr(10))) || '```python' || chr(10)
      || substr(text, instr(text, chr(10)) + 1) || chr(10) || '```' || chr(10) || 'End.'
    ELSE text END AS fenced
  FROM documents)"""


# -- token stream: assistant turns, one row per token ----------------------------------------------


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tokens = regex_tokens(F.col("text"), STREAM_TOKEN)
    turns = (
        c.where(F.col("role") == "assistant")
        .select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), tokens.alias("l"))
        .withColumn("n", F.size("l"))
    )
    rows = explode_once(turns, F.col("l"), "response_id", "n", pos="seq", value="token")
    return rows.select("response_id", "seq", "token", (F.col("seq") == F.col("n") - 1).alias("is_end"))


# -- runs and resource samples from events -----------------------------------------------------------


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return e.select(
        F.col("event_type").alias("model_name"),
        (F.col("event_id") % 6).alias("rep"),
        F.col("user_id").alias("task_id"),
        F.col("value").alias("secs"),
        F.floor(F.col("value") * 10).alias("num_chars"),
    )


def samples_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    metrics = F.array(*[F.lit(m) for m in ("cpu", "gpu", "ram_mb", "vram_mb")])
    return e.select(
        F.col("event_type").alias("model_name"),
        "ts",
        F.col("event_id").alias("sample_id"),
        F.get(metrics, (F.col("event_id") % 4).cast("int")).alias("metric"),
        "value",
    )


SQL_SAMPLES = """
samples AS (
  SELECT event_type AS model_name, ts, event_id AS sample_id, value,
    ['cpu', 'gpu', 'ram_mb', 'vram_mb'][event_id % 4 + 1] AS metric
  FROM events)"""
