"""Embeddings, nearest neighbours, prompts from passages, incremental vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once
from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators import embedding as emb
from corpusloom.operators import ivf, pivots
from corpusloom.operators import retrieval as op
from corpusloom.operators.joins import unseen
from corpusloom.plans.answering import answer_prompts
from corpusloom.functions import prompts
from corpusloom.session import scratch_path
from corpusloom.sources.readers import number_questions
from registry.chunking import sql_level
from registry.derived import sql_uniform, table

LSH = {"bands": 4, "bits": 3}
PASSAGE_SIZE = 500


def _questions(spark, sf):
    q = table(spark, sf, "benchmark", "item_id", "text").withColumnsRenamed(
        {"item_id": "query_id", "text": "question"}
    )
    return q.withColumn("embedding", hash_embedding(F.col("question")))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "embedding")


def _ids_and_distances(hits):
    return hits.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("distance", 6).alias("distance")
    )


def numbered_questions(spark, sf):
    q = table(spark, sf, "benchmark", "item_id", "text")
    return number_questions(q, "text", "item_id")


def hash_embeddings(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", spread=True)
    v = d.withColumn("v", hash_embedding(F.col("text")))
    each = explode_once(v, F.col("v"), "doc_id", pos="bucket").where(F.col("col") != 0)
    return each.select(
        "doc_id", "bucket", F.round(F.col("col").cast("double"), 5).alias("weight")
    )


def knn_l2(spark, sf):
    v = _vectors(spark, sf)
    return _ids_and_distances(op.knn(v, v, 4, "l2", query_id="vec_id", doc_id="vec_id"))


def knn_cosine(spark, sf):
    v = _vectors(spark, sf)
    return _ids_and_distances(op.knn(v, v, 4, "cosine", query_id="vec_id", doc_id="vec_id"))


def knn_l2_many(spark, sf):
    """Every vector asks: queries meet only the pieces that bounds by pivots leave."""
    v = _vectors(spark, sf)
    return _ids_and_distances(pivots.knn_pivots(v, v, 4, query_id="vec_id", doc_id="vec_id").hits)


def _indexed(spark, sf):
    """The index over all vectors, and the queries: every fiftieth row."""
    v = _vectors(spark, sf)
    index = ivf.build_index(v, scratch_path(spark, "ivf"), "vec_id", "embedding", k=4)
    return index, v.where(F.col("vec_id") % 50 == 0)


def knn_ivf(spark, sf):
    index, queries = _indexed(spark, sf)
    return _ids_and_distances(ivf.search_index(queries, index, 4, "vec_id", "embedding"))


def knn_ivf_recall(spark, sf):
    """Does the index find nine of ten true neighbours, the query itself not counted?"""
    v = _vectors(spark, sf)
    index, queries = _indexed(spark, sf)
    true = op.knn(queries, v, 4, "l2", query_id="vec_id", doc_id="vec_id").where("query_id <> doc_id")
    hits = ivf.search_index(queries, index, 4, "vec_id", "embedding").select("query_id", "doc_id", F.lit(1).alias("hit"))
    found = true.join(hits, ["query_id", "doc_id"], "left")
    return found.agg(
        F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached")
    )


def knn_ivf_all_lists(spark, sf):
    """With every list probed the index answers as an exact search does."""
    index, queries = _indexed(spark, sf)
    return _ids_and_distances(ivf.search_index(queries, index, 4, "vec_id", "embedding", len(index.sizes)))


def lsh_buckets(spark, sf):
    codes = F.posexplode(op.lsh_buckets(F.col("embedding"), 64, **LSH))
    return _vectors(spark, sf).select("vec_id", codes).select(
        "vec_id", F.col("pos").cast("bigint").alias("band"), F.col("col").cast("bigint").alias("bucket")
    )


def answer_table(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", spread=True)
    return answer_prompts(d, _questions(spark, sf), "doc_id", "text", PASSAGE_SIZE, sep="\n")


def rag_prompt(spark, sf):
    return answer_table(spark, sf).select("query_id", F.md5("prompt").alias("prompt_md5"))


def _cached(spark, sf):
    """A cache that already holds the German and the Spanish texts."""
    d = table(spark, sf, "documents", "text", "lang").where(F.col("lang").isin("de", "es"))
    known = d.select(emb.text_key(F.col("text")).alias("text_key")).distinct()
    return known.select(
        F.lit("hash-64").alias("model"), "text_key", F.lit("").alias("text"),
        F.array(F.lit(0.0).cast("float")).alias("embedding"),
    )


def embed_cache_misses(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", spread=True)
    return emb.cache_misses(d, _cached(spark, sf), "hash-64").select("model", "text_key")


def embed_cached(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", spread=True)
    rows, _ = emb.embed_with_cache(d, _cached(spark, sf), "hash-64")
    return rows.select(
        "doc_id",
        (F.size("embedding") == 1).alias("from_cache"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3).alias("norm"),
    )


def vector_upsert_new(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "text")
    stored = table(spark, sf, "labels", "doc_id")
    return unseen(d, stored, "doc_id").select("doc_id", "source", F.md5("text").alias("text_md5"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        numbered_questions, hash_embeddings, knn_l2, knn_cosine, knn_l2_many, knn_ivf_recall, knn_ivf_all_lists, lsh_buckets, rag_prompt, embed_cache_misses,
        embed_cached, vector_upsert_new,
    )
}


UNCHECKED = {"knn_ivf": knn_ivf}


def sql_embedding(src: str, key: str, text: str, out: str) -> str:
    """CTE ``out`` (key, v): hashing embedding of ``src`` rows as a list of 64 numbers."""
    return f"""
{out}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS w FROM {src}),
{out}_w AS (SELECT {key}, w, count(*) AS n FROM {out}_t GROUP BY ALL),
{out}_b AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b,
    sum(n * CASE WHEN CAST('0x' || substr(md5(w), 9, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM {out}_w GROUP BY ALL),
{out}_n AS (SELECT {key}, b, CASE WHEN sum(x * x) OVER (PARTITION BY {key}) > 0
    THEN round(x / sqrt(sum(x * x) OVER (PARTITION BY {key})), 6)::FLOAT ELSE 0::FLOAT END AS x FROM {out}_b),
{out}_m AS (SELECT {key}, map_from_entries(list((b, x))) AS m FROM {out}_n GROUP BY {key}),
{out} AS (SELECT s.*, list_transform(range(0, 64), lambda i: coalesce(m[i], 0::FLOAT)) AS v
  FROM {src} s LEFT JOIN {out}_m USING ({key}))"""


def _sql_knn(metric: str) -> str:
    dist = {
        "l2": "list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))",
        "cosine": "list_cosine_distance(a::DOUBLE[], b::DOUBLE[])",
    }[metric]
    return f"""WITH pairs AS (
          SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.embedding AS a, d.embedding AS b
          FROM embeddings q CROSS JOIN embeddings d {{extra}}),
        dist AS (SELECT query_id, doc_id, round(greatest({dist}, 0), 9) AS distance FROM pairs)
        SELECT query_id, rank, doc_id, round(distance, 6) AS distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dist)
        WHERE rank <= 4"""


_L2 = _sql_knn("l2").replace("z[1]", "z[1]")

_SQL_BUCKETS = f"""
  dims AS (SELECT vec_id, i - 1 AS d, embedding[i]::DOUBLE AS x
    FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
  planes AS (SELECT band, bit, d, {sql_uniform("plane", "band", "bit", "d")} - 0.5 AS p
    FROM range({LSH["bands"]}) b(band), range({LSH["bits"]}) t(bit), range(64) r(d)),
  sides AS (SELECT vec_id, band, bit, sum(x * p) > 0 AS side FROM dims JOIN planes USING (d) GROUP BY ALL),
  buckets AS (SELECT vec_id, band, CAST(sum(CASE WHEN side THEN 1 << bit ELSE 0 END) AS BIGINT) AS bucket
    FROM sides GROUP BY ALL)"""

_HEAD, _TAIL = prompts.QA_TEMPLATE.replace("\n", "' || chr(10) || '").split("{context}")
_QUESTION_AT = _TAIL.replace("{question}", "' || question || '")
SQL_RAG_PROMPT = f"'{_HEAD}' || string_agg(t, chr(10) || chr(10) ORDER BY rank) || '{_QUESTION_AT}'"
#: The passages of all documents and, in ``top``, the nearest ones of every question.
SQL_RAG = f"""WITH RECURSIVE
        l0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text AS t FROM documents),
        {sql_level("l0", "l1", chr(10), PASSAGE_SIZE)},
        chunks AS (SELECT lpad(CAST(doc_id AS VARCHAR), 20, '0') || ':' || lpad(CAST(
            row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS VARCHAR), 10, '0') AS chunk_id, t FROM l1),
        {sql_embedding("chunks", "chunk_id", "t", "ce")},
        q AS (SELECT item_id AS query_id, text AS question FROM benchmark),
        {sql_embedding("q", "query_id", "question", "qe")},
        dist AS (SELECT query_id, question, chunk_id, t, round(list_sum(list_transform(list_zip(qe.v, ce.v),
            lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS distance
          FROM qe CROSS JOIN ce),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
          FROM dist) WHERE rank <= 4)"""

ORACLE = {
    "numbered_questions": """SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, text AS question
        FROM benchmark""",
    "hash_embeddings": f"""WITH d AS (SELECT doc_id, text FROM documents), {sql_embedding("d", "doc_id", "text", "e")}
        SELECT doc_id, i AS bucket, round(v[i + 1]::DOUBLE, 5) AS weight
        FROM (SELECT doc_id, v, unnest(range(0, 64)) AS i FROM e) WHERE v[i + 1] <> 0""",
    "knn_l2": _L2.format(extra=""),
    "knn_cosine": _sql_knn("cosine").format(extra=""),
    "lsh_buckets": f"WITH {_SQL_BUCKETS} SELECT vec_id, band, bucket FROM buckets",
    "knn_l2_many": _L2.format(extra=""),
    "knn_ivf_recall": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0",
    "knn_ivf_all_lists": _L2.format(extra="WHERE q.vec_id % 50 = 0"),
    "rag_prompt": SQL_RAG + f"""
        SELECT query_id, md5({SQL_RAG_PROMPT}) AS prompt_md5 FROM top GROUP BY query_id, question""",
    "embed_cache_misses": """
        SELECT DISTINCT 'hash-64' AS model, md5(replace(text, chr(10), ' ')) AS text_key FROM documents
        WHERE md5(replace(text, chr(10), ' ')) NOT IN
          (SELECT md5(replace(text, chr(10), ' ')) FROM documents WHERE lang IN ('de', 'es'))""",
    "embed_cached": f"""WITH d AS (SELECT doc_id, text FROM documents), {sql_embedding("d", "doc_id", "text", "e")}
        SELECT doc_id, from_cache,
          CASE WHEN NOT from_cache AND list_max(list_transform(v, lambda x: abs(x))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE
            AS norm
        FROM (SELECT doc_id, v, md5(replace(text, chr(10), ' ')) IN
          (SELECT md5(replace(text, chr(10), ' ')) FROM documents WHERE lang IN ('de', 'es')) AS from_cache
          FROM e)""",
    "vector_upsert_new": """SELECT doc_id, source, md5(text) AS text_md5 FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
}
