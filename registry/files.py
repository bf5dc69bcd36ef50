"""File filters, metadata, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import files as fn
from registry.derived import SQL_FILES, SQL_KEPT, files_table, kept_files, table


def scan_filter(spark, sf):
    return kept_files(spark, sf).select("doc_id", "path")


def modified_since(spark, sf):
    since = F.expr("timestamp_ntz'2024-01-01 05:00:00'")
    kept = files_table(spark, sf).where(fn.modified_since(F.col("last_modified"), since))
    return kept.select("doc_id", "path")


def file_info(spark, sf):
    content = fn.text_mode(F.col("content"))
    return files_table(spark, sf).select(
        "doc_id",
        fn.extension(F.col("path")).alias("extension"),
        fn.size_bytes(content).alias("size"),
        fn.line_count(content).alias("line_count"),
    )


def _info(df):
    return df.select(
        "doc_id",
        "path",
        "content",
        fn.extension(F.col("path")).alias("extension"),
        fn.size_bytes(F.col("content")).alias("size"),
        fn.line_count(F.col("content")).alias("line_count"),
        fn.iso_timestamp(F.col("last_modified")).alias("last_modified"),
    )


def document_metadata(spark, sf):
    meta = F.create_map(
        F.lit("source"), F.col("path"),
        F.lit("extension"), F.col("extension"),
        F.lit("size"), F.col("size").cast("string"),
        F.lit("line_count"), F.col("line_count").cast("string"),
        F.lit("last_modified"), F.col("last_modified"),
    )
    extra = F.create_map(F.lit("extension"), F.lit("overridden"), F.lit("origin"), F.lit("driver"))
    merged = fn.merge_metadata(meta, extra)
    names = ["source", "extension", "size", "line_count", "last_modified", "origin"]
    return _info(files_table(spark, sf)).select("doc_id", *[merged[n].alias(n) for n in names])


def document_id(spark, sf):
    ids = fn.document_id(
        F.col("path"), F.col("last_modified"), F.lit(0), F.lit(1), F.col("size")
    )
    return _info(files_table(spark, sf)).select("doc_id", ids.alias("document_id"))


def drop_undecodable(spark, sf):
    """Documents without their last byte: those whose last character had several are no text any more."""
    d = table(spark, sf, "documents", "doc_id", "text")
    content = F.col("text").cast("binary")
    cut = d.select("doc_id", F.substring(content, F.lit(1), F.greatest(F.octet_length("text") - 1, F.lit(0))).alias("bytes"))
    return cut.where(fn.decodable(F.col("bytes"))).select("doc_id", F.md5("bytes").alias("content_md5"))


def splitter_route_counts(spark, sf):
    ext = fn.extension(F.col("path"))
    named = kept_files(spark, sf).select(fn.splitter_name(ext).alias("splitter"))
    return named.groupBy("splitter").agg(F.count(F.lit(1)).alias("files"))


def corpus_by_lang(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "text").where(F.col("lang") == "en")
    return d.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def load_documents_unsplit(spark, sf):
    return _info(kept_files(spark, sf)).select(
        F.md5("content").alias("content_md5"),
        F.col("path").alias("source"),
        "extension",
        "size",
        "line_count",
        "last_modified",
    )


QUERIES = {
    "scan_filter": scan_filter,
    "modified_since": modified_since,
    "file_info": file_info,
    "document_metadata": document_metadata,
    "document_id": document_id,
    "drop_undecodable": drop_undecodable,
    "splitter_route_counts": splitter_route_counts,
    "corpus_by_lang": corpus_by_lang,
    "load_documents_unsplit": load_documents_unsplit,
}

_SQL_INFO = """
info AS (
  SELECT doc_id, path, content, regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1) AS extension,
    CAST(strlen(content) AS BIGINT) AS size,
    CAST(length(content) - length(replace(content, chr(10), ''))
      + CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS line_count,
    strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified
  FROM {src})"""

ORACLE = {
    "scan_filter": f"WITH {SQL_KEPT} SELECT doc_id, path FROM kept",
    "modified_since": f"""WITH {SQL_FILES}
        SELECT doc_id, path FROM files WHERE last_modified >= TIMESTAMP '2024-01-01 05:00:00'""",
    "file_info": f"""WITH {SQL_FILES}, {_SQL_INFO.format(src="files")}
        SELECT doc_id, extension, size, line_count FROM info""",
    "document_metadata": f"""WITH {SQL_FILES}, {_SQL_INFO.format(src="files")}
        SELECT doc_id, path AS source, 'overridden' AS extension, CAST(size AS VARCHAR) AS size,
          CAST(line_count AS VARCHAR) AS line_count, last_modified, 'driver' AS origin FROM info""",
    "drop_undecodable": """SELECT doc_id, md5(left(text, length(text) - 1)) AS content_md5 FROM documents
        WHERE text = '' OR octet_length(encode(right(text, 1))) = 1""",
    "document_id": f"""WITH {SQL_FILES}, {_SQL_INFO.format(src="files")}
        SELECT doc_id, 'path=''' || path || ''':last_modified=''' || last_modified || ''':0/1:size='
          || CAST(size AS VARCHAR) AS document_id FROM info""",
    "splitter_route_counts": f"""WITH {SQL_KEPT}
        SELECT CASE WHEN ends_with(path, '.py') THEN 'python_ast' WHEN ends_with(path, '.md') THEN 'markdown'
          ELSE 'recursive' END AS splitter, count(*) AS files FROM kept GROUP BY 1""",
    "corpus_by_lang": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE lang = 'en'",
    "load_documents_unsplit": f"""WITH {SQL_KEPT}, {_SQL_INFO.format(src="kept")}
        SELECT md5(content) AS content_md5, path AS source, extension, size, line_count, last_modified
        FROM info""",
}
