"""Indexing a source tree: scan, split, id, embed through the cache, store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import files as fn
from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators.chunking import chunk_routed, number_parts
from corpusloom.operators.embedding import Embedder, attach_embeddings, cache_misses
from corpusloom.operators.joins import unseen
from corpusloom.session import checkpointed
from corpusloom.sources import tables
from corpusloom.sources.filetree import scan_files

_KEEP = ("path", "extension", "size", "line_count", "last_modified")
SplitterFactory = Callable[[Column, Column], Column]


def to_documents(files: DataFrame, extra: Column | None = None) -> DataFrame:
    """(content, metadata map) of whole files; keys of ``extra`` win."""
    meta = F.create_map(
        F.lit("source"), F.col("path"),
        F.lit("extension"), F.col("extension"),
        F.lit("size"), F.col("size").cast("string"),
        F.lit("line_count"), F.col("line_count").cast("string"),
        F.lit("last_modified"), fn.iso_timestamp(F.col("last_modified")),
    )
    content = fn.require(F.col("content"), "document without content")
    merged = meta if extra is None else fn.merge_metadata(meta, extra)
    return files.select(content.alias("content"), merged.alias("metadata"))


def load_documents(
    spark: SparkSession,
    root: str,
    splitter: Callable[[Column], Column] | None = None,
    splitter_factory: SplitterFactory | None = None,
    **scan: object,
) -> DataFrame:
    """Scanned files as documents, or as numbered chunks.

    ``splitter`` maps the content to array<string>; ``splitter_factory`` maps content and extension.
    """
    if splitter and splitter_factory:
        raise ValueError("give either splitter or splitter_factory")
    found = scan_files(spark, root, **scan)
    if not splitter and not splitter_factory:
        return to_documents(found)
    content = F.col("content")
    chunks = splitter(content) if splitter else splitter_factory(content, F.col("extension"))
    return number_parts(found.withColumn("__c", chunks), F.col("__c"), *_KEEP)


def with_document_id(chunks: DataFrame) -> DataFrame:
    iso = fn.iso_timestamp(F.col("last_modified"))
    ids = fn.document_id(F.col("path"), iso, F.col("part"), F.col("num_parts"), F.col("size"))
    return chunks.withColumn("doc_id", ids)


def chunks_of(files: DataFrame, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with doc_id, errors) of scanned files, each split by the splitter of its type."""
    chunks, errors = chunk_routed(files, *_KEEP, **sizes)
    return with_document_id(chunks), errors


def store_chunks(
    chunks: DataFrame,
    table_path: str,
    cache_path: str,
    model: str = "hash-64",
    embedder: Embedder = hash_embedding,
    reset: bool = False,
) -> None:
    """Embed and store chunks. The cache is committed first and survives a failure of the store."""
    spark = chunks.sparkSession
    if not reset and tables.table_exists(spark, table_path):
        chunks = unseen(chunks, spark.read.parquet(table_path), "doc_id")
    chunks = checkpointed(chunks, "chunks")
    cache = tables.load_embedding_cache(spark, cache_path)
    tables.save_embedding_cache(cache_misses(chunks, cache, model, embedder, "content"), cache_path)
    cache = tables.load_embedding_cache(spark, cache_path)
    rows = attach_embeddings(chunks, cache, model, "content")
    tables.write_vector_table(rows, table_path, reset)


def index_source_tree(
    spark: SparkSession,
    root: str,
    table_path: str,
    cache_path: str,
    reset: bool = True,
    modified_after: datetime | None = None,
    model: str = "hash-64",
    embedder: Embedder = hash_embedding,
    **sizes: int,
) -> DataFrame:
    """Index a tree; gives the files that could not be split, with the reason.

    Without ``reset`` only chunks with new ids are embedded and added. ``modified_after`` limits the
    scan to files that changed since then.
    """
    # read once: every later step sees the same contents, also if a file changes meanwhile
    files = checkpointed(scan_files(spark, root, modified_after=modified_after), "scanned")
    chunks, errors = chunks_of(files, **sizes)
    store_chunks(chunks, table_path, cache_path, model, embedder, reset)
    return errors
