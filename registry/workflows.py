"""Whole workflows through their real entry points: documents are laid out as files or tables in the
shared folder and read back, indexed, completed, stored and shown."""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once
from corpusloom.functions.models import complete_tasks
from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators import completions as op
from corpusloom.operators import embedding as emb
from corpusloom.operators.chunking import char_chunks, python_ast_blocks
from corpusloom.plans.answering import answer_from_table, passages
from corpusloom.plans.indexing import index_source_tree, load_documents
from corpusloom.session import scratch_path
from corpusloom.sources import readers, tables, versions
from corpusloom.sources.filetree import scan_files, write_files
from corpusloom.streaming.corpus import index_changes_stream
from registry.derived import MODELS, SQL_FILES, SQL_KEPT, SQL_TASKS, TASK_LANG, files_table, table, todo_table
from registry.retrieval import PASSAGE_SIZE, SQL_RAG, SQL_RAG_PROMPT, sql_embedding
from registry.text import _MODELS, _sql_escape


def _folder(spark, name: str) -> str:
    """A fresh folder of files; the file tree source wants a path, not a URL."""
    return scratch_path(spark, name).removeprefix("file://").replace("file:/", "/")


def _tree(spark, sf) -> str:
    root = _folder(spark, "tree")
    files = files_table(spark, sf).select(F.substring("path", 9, 10_000).alias("rel_path"), "content")
    write_files(files, root)
    return root


def _below(root: str):
    return F.substring_index("path", f"/{root.rsplit('/', 1)[1]}/", -1)


def scan_files_tree(spark, sf):
    root = _tree(spark, sf)
    return scan_files(spark, root).select(
        _below(root).alias("rel_path"), F.md5("content").alias("content_md5"), "extension", "size", "line_count"
    )


def scan_files_objects(spark, sf):
    """The tree written and scanned as objects of a store, by its URI."""
    root = f"file://{_folder(spark, 'objects')}"
    files = files_table(spark, sf).select(F.substring("path", 9, 10_000).alias("rel_path"), "content")
    write_files(files, root)
    return scan_files(spark, root).select(
        _below(root).alias("rel_path"), F.md5("content").alias("content_md5"), "extension", "size", "line_count"
    )


def source_tree(spark, sf):
    root = _tree(spark, sf)
    found = readers.read_source_tree(spark, root, ".py")
    return found.select(_below(root).alias("rel_path"), F.md5("content").alias("content_md5"))


def text_documents(spark, sf):
    root = _tree(spark, sf)
    found = readers.read_text_document(spark, root).withColumnRenamed("source", "path")
    return found.select(_below(root).alias("rel_path"), F.md5("content").alias("content_md5"))


def load_documents_tree(spark, sf):
    root = _tree(spark, sf)
    return load_documents(spark, root).select(
        F.substring_index(F.col("metadata")["source"], f"/{root.rsplit('/', 1)[1]}/", -1).alias("rel_path"),
        F.md5("content").alias("content_md5"),
        F.col("metadata")["extension"].alias("extension"),
        F.col("metadata")["size"].alias("size"),
        F.col("metadata")["line_count"].alias("line_count"),
    )


def load_documents_split(spark, sf):
    root = _tree(spark, sf)
    parts = load_documents(spark, root, splitter=lambda c: char_chunks(c, "\n", 1, 0))
    return parts.select(_below(root).alias("rel_path"), "part", "num_parts", F.md5("content").alias("content_md5"))


def completion_task_files(spark, sf):
    root = _folder(spark, "tasks")
    tasks = todo_table(spark, sf)
    write_files(tasks.select(F.concat_ws("/", "lang_id", F.concat(F.lit("t"), "doc_id")).alias("rel_path"),
                             F.col("code").alias("content")), root)
    langs = ["rust", "python", "ruby", "c-sharp", "scala"]
    read = [readers.read_completion_tasks(spark, root, lang)[0] for lang in langs]
    every = functools.reduce(lambda a, b: a.unionByName(b), read)
    return every.select("task_name", "lang_id", F.md5("prefix").alias("prefix_md5"), F.md5("suffix").alias("suffix_md5"))


def snippet_files(spark, sf):
    root = _folder(spark, "snippets")
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    write_files(rows.select(F.concat_ws("-", "conv_id", "turn").alias("rel_path"), F.col("text").alias("content")), root)
    return readers.read_snippets(spark, root).select("snippet_name", F.md5("code").alias("code_md5"))


class _Shout:
    """A stand-in model: its name and the length of the prompt, behind the prompt."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, prompts: pd.Series) -> pd.Series:
        return prompts + self.name + " " + prompts.str.len().astype(str)


class _Capitals(_Shout):
    """A stand-in model that works on the whole prompt: its name and the prompt in capitals, behind the prompt."""

    def __call__(self, prompts: pd.Series) -> pd.Series:
        # Letter by letter, as SQL has it; Python makes two letters of some.
        capitals = pc.utf8_upper(pa.Array.from_pandas(prompts, type=pa.large_string())).to_pandas()
        return prompts + self.name + " " + capitals.set_axis(prompts.index)


def _completed(spark, sf, model=_Shout):
    code = todo_table(spark, sf)
    at = F.instr("code", "<todo>")
    tasks = code.select(
        F.concat(F.lit("t"), "doc_id").alias("task_name"), "lang_id",
        F.substring("code", F.lit(1), at - 1).alias("prefix"),
        F.substring("code", at + 6, F.length("code")).alias("suffix"),
    )
    grid = op.task_model_grid(tasks, MODELS)
    return complete_tasks(grid, {m: functools.partial(model, m) for m in MODELS})


def completed_tasks(spark, sf):
    return _completed(spark, sf).select(
        "task_name", "model_id", "completion", F.md5("full_code").alias("full_code_md5")
    )


def stored_completions_all(spark, sf):
    """Tasks of every language, answered by models, written as files and read back."""
    out = _folder(spark, "results")
    tables.write_results(_completed(spark, sf, _Capitals), out)
    read = [
        op.stored_results(readers.read_stored_completions(spark, f"{out}/{lang}")).withColumn("lang_id", F.lit(lang))
        for lang in TASK_LANG
    ]
    stored = functools.reduce(lambda a, b: a.unionByName(b), read)
    return stored.select("task_name", "lang_id", "task", F.explode("completions")).select(
        "task_name", "lang_id", F.md5("task").alias("task_md5"), F.col("key").alias("model_id"),
        F.md5("value").alias("full_code_md5"),
    )


def report_pages(spark, sf):
    out = scratch_path(spark, "report")
    rows = _completed(spark, sf).withColumn("task", F.concat("prefix", F.lit("<todo>"), "suffix"))
    tables.write_html_report(rows, out, compression="gzip")
    lines = spark.read.text(out).select("lang_id", F.col("value").alias("line"))
    heads = F.sum(F.when(F.contains("line", F.lit("<h2>")), 1).otherwise(0))
    return lines.groupBy("lang_id").agg(
        heads.alias("tasks"),
        F.sum(F.when(F.startswith("line", F.lit("<html>")), 1).otherwise(0)).alias("starts"),
        F.sum(F.when(F.endswith("line", F.lit("</html>")), 1).otherwise(0)).alias("ends"),
    )


def report_lines(spark, sf):
    """Every line of the pages, by value."""
    out = scratch_path(spark, "report")
    rows = _completed(spark, sf).withColumn("task", F.concat("prefix", F.lit("<todo>"), "suffix"))
    tables.write_html_report(rows, out, compression="gzip")
    lines = spark.read.option("lineSep", "\n").text(out)
    # 16 bytes a line pass the shuffle
    counted = lines.groupBy("lang_id", F.unhex(F.md5("value")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("lang_id", F.lower(F.hex("line")).alias("line_md5"), "n")


def indexed_whole_tree(spark, sf):
    """Every file of a tree, indexed twice with the default sizes: its chunks are numbered without gaps and have
    vectors, or the file is among the errors."""
    root, stored, cache = _tree(spark, sf), scratch_path(spark, "chunks"), scratch_path(spark, "cache")
    for reset in (True, False):
        errors = index_source_tree(spark, root, stored, cache, reset=reset)
    whole = (
        (F.count("*") == F.max("num_parts")) & (F.count_distinct("part") == F.max("num_parts"))
        & (F.min("part") == 0) & (F.max("part") == F.max("num_parts") - 1) & (F.min(F.size("embedding")) == 64)
    )
    chunks = spark.read.parquet(stored).groupBy("path").agg(whole.alias("settled"))
    every = chunks.unionByName(errors.select("path", F.col("error").isNotNull().alias("settled")))
    return every.select(_below(root).alias("rel_path"), "settled")


def _weights(rows, key: str):
    """Every number of a vector that is not 0."""
    each = explode_once(rows, F.col("embedding"), key, pos="bucket").where(F.col("col") != 0)
    return each.select(key, "bucket", F.round(F.col("col").cast("double"), 5).alias("weight"))


def cache_whole_table(spark, sf):
    """The vectors of all documents through a cache that a first run has left with half of them."""
    path = scratch_path(spark, "cache")
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", spread=True)
    for part in (docs.where(F.col("lang").isin("de", "es")), docs):
        misses = emb.cache_misses(part, tables.load_embedding_cache(spark, path), "hash-64")
        tables.save_embedding_cache(misses, path)
    cache = tables.load_embedding_cache(spark, path)
    return _weights(emb.attach_embeddings(docs.select("doc_id", "text"), cache, "hash-64"), "doc_id")


def _changes(spark, sf):
    """A history of files made of the documents, with a number for the batch that brings each change.

    Every document is written twice, and of every seven one vanishes, half of which come back. Batches bring newer
    versions before older ones.
    """
    d = table(spark, sf, "documents", "doc_id", "text")
    doc = F.col("doc_id")

    def version(k: int, content, gone: bool):
        return F.struct(F.lit(k).alias("k"), content.alias("content"), F.lit(gone).alias("gone"))

    events = F.array(
        version(1, F.concat(F.lit("old "), F.col("text")), False),
        version(2, F.col("text"), False),
        F.when(doc % 7 == 3, version(3, F.lit(None).cast("string"), True)),
        F.when(doc % 14 == 3, version(4, F.concat("text", F.lit(" again")), False)),
    )
    rows = d.select("doc_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return rows.select(
        F.concat(F.lit("/corpus/doc_"), doc.cast("string"), F.lit(".txt")).alias("path"),
        F.lit(".txt").alias("extension"),
        F.octet_length("e.content").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("line_count"),
        F.timestamp_add("MINUTE", F.col("e.k"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("last_modified"),
        "e.content",
        "e.gone",
        ((doc + 2 * F.col("e.k")) % 3).alias("batch"),
    )


def _current(spark, path):
    chunks = versions.current_chunks(spark, path)
    return _weights(chunks.where("part = 0 and num_parts = 1"), "path")


def index_changes(spark, sf):
    """The index after three unordered batches of changes and a compaction."""
    path, cache = scratch_path(spark, "versions"), scratch_path(spark, "cache")
    changes = _changes(spark, sf)
    for batch in range(3):
        part = changes.where(F.col("batch") == batch).drop("batch")
        versions.apply_changes(part, path, batch, cache, size=10_000_000, overlap=0)
    versions.compact(spark, path)
    return _current(spark, path)


def index_changes_streaming(spark, sf):
    """The same changes as a stream of three micro-batches."""
    path, cache = scratch_path(spark, "versions"), scratch_path(spark, "cache")
    folder = scratch_path(spark, "changes")
    changes = _changes(spark, sf)
    schema = changes.drop("batch").schema
    # A write per batch, in as many files as the scan has tasks at most; the stream takes so many at a time.
    for batch in range(3):
        changes.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(folder)
    files = max(1, -(-len(spark.read.schema(schema).parquet(folder).inputFiles()) // 3))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    state = scratch_path(spark, "state")
    index_changes_stream(source, path, cache, state, size=10_000_000, overlap=0).awaitTermination()
    return _current(spark, path)


def python_blocks(spark, sf):
    """Code whose blocks SQL can state, from every document."""
    docs = table(spark, sf, "documents", "doc_id", "n_chars", "source")
    code = F.concat(
        F.lit("import "), "source", F.lit("  # lost\nx = "), "n_chars", F.lit("\n'''"), "source", F.lit("\n"), "n_chars",
        F.lit("'''\ndef f():\n  return "), "doc_id", F.lit("\n"),
    )
    parsed = docs.select("doc_id", python_ast_blocks(code).alias("p"))
    return parsed.select("doc_id", F.posexplode("p.blocks").alias("part", "block")).select(
        "doc_id", F.col("part").cast("bigint").alias("part"), "block"
    )


def corpus_of_lang(spark, sf):
    path = scratch_path(spark, "corpus")
    table(spark, sf, "documents", "doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    found = readers.read_corpus(spark, path, "fr", text_col="text")
    return found.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def rag_answer_whole_table(spark, sf):
    """All documents as passages in a stored vector table; questions are asked of it and answered by a model."""
    stored = scratch_path(spark, "chunks")
    docs = table(spark, sf, "documents", "doc_id", "text", spread=True)
    chunks = passages(docs, "doc_id", "text", PASSAGE_SIZE, "\n")
    rows = chunks.select(F.col("chunk_id").alias("doc_id"), "content", hash_embedding(F.col("content")).alias("embedding"))
    tables.write_vector_table(rows, stored)
    questions = table(spark, sf, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    answered = answer_from_table(spark, stored, questions, functools.partial(_Shout, "m"))
    return answered.select(
        "query_id", F.array_join("chunk_ids", " ").alias("chunk_ids"), F.md5("prompt").alias("prompt_md5"),
        F.md5("answer").alias("answer_md5"),
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        scan_files_tree, scan_files_objects, source_tree, text_documents, load_documents_tree, load_documents_split, completion_task_files,
        snippet_files, completed_tasks, stored_completions_all, report_pages, report_lines, indexed_whole_tree, cache_whole_table,
        index_changes, index_changes_streaming, python_blocks, corpus_of_lang, rag_answer_whole_table,
    )
}

_EXT = "regexp_extract(path, '^.*/.+(\\.[^./]+)$', 1)"
_REL = "substr(path, 9) AS rel_path"
_LINES = "CAST(len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) OR content = '' THEN 1 ELSE 0 END AS BIGINT)"
_DONE = f"""{SQL_TASKS}, models(m) AS (VALUES {_MODELS}),
  done AS (SELECT 't' || doc_id AS task_name, lang_id, m, prefix, suffix,
    m || ' ' || length('<fim-prefix>' || prefix || '<fim-suffix>' || suffix || '<fim-middle>') AS completion
    FROM tasks CROSS JOIN models)"""
_DONE_WHOLE = f"""{SQL_TASKS}, models(m) AS (VALUES {_MODELS}),
  done AS (SELECT 't' || doc_id AS task_name, lang_id, m, prefix, suffix,
    m || ' ' || upper('<fim-prefix>' || prefix || '<fim-suffix>' || suffix || '<fim-middle>') AS completion
    FROM tasks CROSS JOIN models)"""
_PROMPT = SQL_RAG_PROMPT
_CHANGED = f"""WITH d AS (SELECT '/corpus/doc_' || doc_id || '.txt' AS path,
      text || CASE WHEN doc_id % 14 = 3 THEN ' again' ELSE '' END AS text
    FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 14 = 3),
  {sql_embedding("d", "path", "text", "e")}
  SELECT path, i AS bucket, round(v[i + 1]::DOUBLE, 5) AS weight
  FROM (SELECT path, v, unnest(range(0, 64)) AS i FROM e) WHERE v[i + 1] <> 0"""

_SCANNED = f"""WITH {SQL_KEPT} SELECT {_REL}, md5(content) AS content_md5, {_EXT} AS extension,
        CAST(strlen(content) AS BIGINT) AS size, {_LINES} AS line_count FROM kept"""

ORACLE = {
    "scan_files_tree": _SCANNED,
    "scan_files_objects": _SCANNED,
    "source_tree": f"WITH {SQL_FILES} SELECT {_REL}, md5(content) AS content_md5 FROM files WHERE doc_id % 5 = 0",
    "text_documents": f"WITH {SQL_FILES} SELECT {_REL}, md5(content) AS content_md5 FROM files",
    "load_documents_tree": f"""WITH {SQL_KEPT} SELECT {_REL}, md5(content) AS content_md5, {_EXT} AS extension,
        CAST(strlen(content) AS VARCHAR) AS size, CAST({_LINES} AS VARCHAR) AS line_count FROM kept""",
    "load_documents_split": f"""WITH {SQL_KEPT},
        l AS (SELECT *, list_filter(string_split(content, chr(10)), lambda x: x <> '') AS ls FROM kept)
        SELECT {_REL}, unnest(generate_series(0, len(ls) - 1)) AS part, len(ls) AS num_parts, md5(unnest(ls)) AS content_md5
        FROM l""",
    "completion_task_files": f"""WITH {SQL_TASKS}
        SELECT 't' || doc_id AS task_name, lang_id, md5(prefix) AS prefix_md5, md5(suffix) AS suffix_md5 FROM tasks""",
    "snippet_files": "SELECT conv_id || '-' || turn AS snippet_name, md5(text) AS code_md5 FROM conversations",
    "completed_tasks": f"""WITH {_DONE} SELECT task_name, m AS model_id, completion,
        md5(prefix || completion || suffix) AS full_code_md5 FROM done""",
    "stored_completions_all": f"""WITH {_DONE_WHOLE} SELECT task_name, lang_id, md5(prefix || '<todo>' || suffix) AS task_md5,
        m AS model_id, md5(prefix || completion || suffix) AS full_code_md5 FROM done""",
    "report_lines": f"""WITH {_DONE},
        parts AS (SELECT lang_id, '<h2>' || task_name || '</h2><pre>' || {_sql_escape("prefix")}
            || '<span class="placeholder">&lt;todo&gt;</span>' || {_sql_escape("suffix")}
            || '</pre><table class="answers"><tr>' || string_agg(CASE WHEN m = 'runs/ckpt-6000' THEN '</tr><tr>' ELSE '' END
              || '<td><h4>' || m || '</h4><pre>' || {_sql_escape("prefix || completion || suffix")} || '</pre></td>', '' ORDER BY m)
            || '</tr></table>' AS html
          FROM done GROUP BY lang_id, task_name, prefix, suffix
          UNION ALL SELECT DISTINCT lang_id, '<html><head><style>{op.PAGE_STYLE}</style></head><body><main><h1>' || lang_id
            || '</h1>' FROM done
          UNION ALL SELECT DISTINCT lang_id, '{op.PAGE_END}' FROM done)
        SELECT lang_id, md5(line) AS line_md5, count(*) AS n
        FROM (SELECT lang_id, unnest(string_split(html, chr(10))) AS line FROM parts) GROUP BY 1, 2""",
    "report_pages": f"""WITH {_DONE} SELECT lang_id, CAST(count(DISTINCT task_name) AS BIGINT) AS tasks,
        CAST(1 AS BIGINT) AS starts, CAST(1 AS BIGINT) AS ends FROM done GROUP BY 1""",
    "indexed_whole_tree": f"WITH {SQL_KEPT} SELECT {_REL}, true AS settled FROM kept",
    "cache_whole_table": f"""WITH d AS (SELECT doc_id, text FROM documents), {sql_embedding("d", "doc_id", "text", "e")}
        SELECT doc_id, i AS bucket, round(v[i + 1]::DOUBLE, 5) AS weight
        FROM (SELECT doc_id, v, unnest(range(0, 64)) AS i FROM e) WHERE v[i + 1] <> 0""",
    "index_changes": _CHANGED,
    "index_changes_streaming": _CHANGED,
    "python_blocks": """SELECT doc_id, unnest(generate_series(0, 3)) AS part, unnest(['import ' || source,
          chr(10) || 'x = ' || n_chars, '\"\"\"' || source || chr(10) || n_chars || '\"\"\"',
          chr(10) || 'def f():' || chr(10) || '    return ' || doc_id]) AS block FROM documents""",
    "corpus_of_lang": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE lang = 'fr'",
    "rag_answer_whole_table": SQL_RAG + f"""
        SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids, md5({_PROMPT}) AS prompt_md5,
          md5({_PROMPT} || 'm ' || length({_PROMPT})) AS answer_md5
        FROM top GROUP BY query_id, question""",
}
