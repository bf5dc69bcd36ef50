"""Question answering over a corpus: passages, nearest neighbours, one prompt per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.models import ModelFactory, apply_model
from corpusloom.functions.prompts import qa_prompt
from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators.chunking import char_chunks, number_parts
from corpusloom.operators.embedding import Embedder
from corpusloom.operators.joins import skew_safe_lookup
from corpusloom.operators.retrieval import MAX_BROADCAST_QUERIES, knn, stuff_context
from corpusloom.session import checkpointed


def passages(
    docs: DataFrame, key: str, text: str, size: int, sep: str = "\n\n"
) -> DataFrame:
    """(chunk_id, key, part, num_parts, content): numbered chunks with an id that sorts by document and part."""
    split = docs.withColumn("__chunks", char_chunks(F.col(text), sep, size))
    chunk_id = F.concat_ws(":", F.lpad(F.col(key).cast("string"), 20, "0"), F.lpad(F.col("part").cast("string"), 10, "0"))
    return number_parts(split, F.col("__chunks"), key).withColumn("chunk_id", chunk_id)


def retrieve(
    questions: DataFrame, chunks: DataFrame, k: int = 4, metric: str = "l2", embedder: Embedder = hash_embedding
) -> DataFrame:
    """(query_id, chunk_id, rank): nearest chunks; only ids and vectors take part."""
    vectors = chunks.select("chunk_id", embedder(F.col("content")).alias("embedding"))
    return knn(questions, vectors, k, metric, "query_id", "chunk_id").withColumnRenamed("doc_id", "chunk_id")


def answer_prompts(
    docs: DataFrame,
    questions: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 1000,
    k: int = 4,
    sep: str = "\n\n",
    embedder: Embedder = hash_embedding,
) -> DataFrame:
    """(query_id, question, prompt). ``questions`` has (query_id, question, embedding).

    Only ids and vectors take part in the search; the contents of the few hits are fetched in a
    second pass over the corpus.
    """
    chunks = passages(docs, key, text, size, sep)
    hits = retrieve(questions.select("query_id", "embedding"), chunks, k, embedder=embedder)
    few = questions.limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES
    contexts = stuff_context(with_content(hits, chunks.select("chunk_id", "content"), few))
    return contexts.join(questions.select("query_id", "question"), "query_id").select(
        "query_id", "question", qa_prompt(F.col("context"), F.col("question")).alias("prompt")
    )


def answer_from_table(
    spark: SparkSession,
    table_path: str,
    questions: DataFrame,
    model: ModelFactory,
    k: int = 4,
    metric: str = "l2",
    embedder: Embedder = hash_embedding,
) -> DataFrame:
    """(query_id, question, chunk_ids, prompt, answer) from a stored vector table.

    ``questions`` has (query_id, question). The stored vectors are searched as they are: nothing is split or
    embedded but the questions. The texts of the hits are fetched by id, then the model answers.
    """
    stored = spark.read.parquet(table_path).withColumnRenamed("doc_id", "chunk_id")
    asked = questions.select("query_id", "question", embedder(F.col("question")).alias("embedding"))
    hits = knn(asked.select("query_id", "embedding"), stored.select("chunk_id", "embedding"), k, metric, "query_id", "chunk_id")
    hits = hits.withColumnRenamed("doc_id", "chunk_id")
    few = questions.limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES
    found = checkpointed(with_content(hits, stored.select("chunk_id", "content"), few), "passages")
    ids = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("h"))
    named = ids.select("query_id", F.transform("h", lambda x: x["chunk_id"]).alias("chunk_ids"))
    prompts = stuff_context(found).join(named, "query_id").join(asked.select("query_id", "question"), "query_id")
    prompts = prompts.withColumn("prompt", qa_prompt(F.col("context"), F.col("question")))
    answered = apply_model(prompts, "prompt", model, "answer")
    return answered.select("query_id", "question", "chunk_ids", "prompt", "answer")


def with_content(hits: DataFrame, chunks: DataFrame, few: bool) -> DataFrame:
    """Add ``content`` to (query_id, chunk_id, rank).

    ``few`` hits (k per query, their number checked) are broadcast, so no text moves but theirs.
    Otherwise chunks that nobody asks for are dropped before the join, and popular ones do not skew it.
    """
    if few:
        return chunks.join(F.broadcast(hits), "chunk_id")
    wanted = hits.select("chunk_id").distinct()
    return skew_safe_lookup(hits, chunks.join(wanted, "chunk_id", "left_semi"), "chunk_id")
