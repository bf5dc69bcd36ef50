"""Nearest neighbours, caches and joins against brute force, with hot keys and copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.tokens import hash_embedding
from corpusloom.operators import embedding as emb
from corpusloom.operators import retrieval as op
from corpusloom.operators import vocabulary as voc
from corpusloom.operators.joins import hot_keys, skew_safe_lookup, unseen


def vectors(seed=0, n=90, dim=8):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[n // 3 : 2 * n // 3] = data[0]  # a third are copies of one vector
    data[-1] = 0.0
    return data


def frame(spark, data):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<float>")


def brute(data, k, metric, allowed=None):
    x = data.astype(np.float64)
    found = set()
    for q in range(len(x)):
        if metric == "l2":
            dist = ((x - x[q]) ** 2).sum(axis=1)
        else:
            norms = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
            dist = 1 - np.divide(x @ x[q], norms, out=np.zeros(len(x)), where=norms > 0)
        dist = np.round(np.maximum(dist, 0), 9)
        ids = [d for d in range(len(x)) if allowed is None or allowed(q, d)]
        best = sorted(ids, key=lambda d: (dist[d], d))[:k]
        found |= {(q, d, rank) for rank, d in enumerate(best, start=1)}
    return found


def result(hits):
    return {(r.query_id, r.doc_id, r.rank) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("max_broadcast", [1000, 5])
def test_knn_is_exact(spark, metric, max_broadcast):
    data = vectors()
    df = frame(spark, data).repartition(5)
    hits = op.knn(df, df, 4, metric, "id", "id", "v", max_broadcast)
    assert result(hits) == brute(data, 4, metric)


def test_knn_in_small_blocks(spark):
    data = vectors(1)
    q, c = op._sides(frame(spark, data), frame(spark, data), "id", "id", "v")
    assert result(op._knn_blocks(q, c, 3, "l2", block_rows=20)) == brute(data, 3, "l2")


def test_knn_with_string_ids_and_fewer_documents_than_k(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "id string, v array<float>")
    q = spark.createDataFrame([("q", [0.0, 0.0])], "id string, v array<float>")
    assert result(op.knn(q, docs, 4, "l2", "id", "id", "v")) == {("q", "a", 1), ("q", "b", 2)}
    assert op.knn(q.limit(0), docs, 4, "l2", "id", "id", "v").count() == 0


@pytest.mark.parametrize("block_rows", [10_000, 7])
def test_lsh_ranks_all_documents_of_shared_buckets(spark, block_rows):
    data = vectors(2)
    planes = op.hyperplanes(8, 3, 2)
    sides = (data.astype(np.float64) @ planes.T > 0).reshape(len(data), 3, 2)
    shared = lambda q, d: bool((sides[q] == sides[d]).all(axis=1).any())
    df = frame(spark, data)
    hits = op.knn_lsh(df, df, 4, "l2", 8, 3, 2, 0, "id", "id", "v", block_rows)
    assert result(hits) == brute(data, 4, "l2", shared)


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16)) * 4
    data = np.vstack([c + rng.normal(size=(30, 16)) * 0.3 for c in centres]).astype(np.float32)
    df = frame(spark, data)
    exact = result(op.knn(df, df, 4, "l2", "id", "id", "v"))
    near = result(op.knn_lsh(df, df, 4, "l2", 16, 6, 4, 0, "id", "id", "v"))
    pairs = lambda hits: {(q, d) for q, d, _ in hits}
    assert len(pairs(exact) & pairs(near)) / len(exact) > 0.95
    assert all((q, q) in pairs(near) for q in range(len(data)))


def test_context_is_ordered_by_rank(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "query_id int, rank int, content string")
    got = {r.query_id: r.context for r in op.stuff_context(hits).collect()}
    assert got == {1: "a\n\nb", 2: "c"}


def test_cache_computes_each_text_once_per_model(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a\nb"), (2, "a b"), (3, "new"), (4, "a\nb")], "id int, text string")
    cache = spark.createDataFrame([("m1", None, "a b", [1.0])], emb.CACHE_SCHEMA).withColumn(
        "text_key", emb.text_key(F.col("text"))
    )
    misses = emb.cache_misses(texts, cache, "m1").collect()
    assert [(m.model, m.text) for m in misses] == [("m1", "new")]
    # the key includes the model: another model finds nothing
    assert {m.text for m in emb.cache_misses(texts, cache, "m2").collect()} == {"a b", "new"}
    rows, _ = emb.embed_with_cache(texts, cache, "m1")
    sizes = {r.id: len(r.embedding) for r in rows.collect()}
    assert sizes == {1: 1, 2: 1, 3: 64, 4: 1}


def test_hash_embedding_is_a_unit_vector_or_zero(spark):
    df = spark.createDataFrame([("One two, two THREE",), ("one TWO two three",), ("",), ("?!",), (None,)], "t string")
    got = [np.array(r[0]) for r in df.select(hash_embedding(F.col("t"))).collect()]
    assert np.allclose(got[0], got[1]) and abs(np.linalg.norm(got[0]) - 1) < 1e-5
    assert all(not v.any() and len(v) == 64 for v in got[2:])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_with_a_hot_key(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    right = spark.createDataFrame([("hot", 1, [1]), *[(f"k{i}", i, [i]) for i in range(40)]], "k string, v int, a array<int>")
    hot = hot_keys(left, "k", sample=1.0, min_sampled=500)
    assert [r.k for r in hot.collect()] == ["hot"]
    got = skew_safe_lookup(left, right, "k", how, hot)
    assert got.columns == ["id", "k", "v", "a"]
    expected = left.join(right, "k", how).select("id", "k", "v", "a")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got) == rows(expected)
    assert rows(skew_safe_lookup(left, right, "k", how)) == rows(expected)


def test_unseen(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in unseen(new, new.limit(0), "k").orderBy("k").collect()] == [("a", 1), ("b", 2)]
    assert unseen(new, new, "k").count() == 0


@pytest.mark.parametrize("max_broadcast", [100, 1])
def test_token_ids(spark, max_broadcast):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["zz"])], "id int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("zz", 2)], "token string, token_id long")
    got = {r.id: r.token_ids for r in voc.token_ids(docs, vocab, "id", max_broadcast=max_broadcast).collect()}
    assert got == {1: [1, 0, 1], 2: [], 3: [2]}
    part = vocab.where("token <> 'zz'")
    with pytest.raises(Exception, match="token without id"):
        voc.token_ids(docs, part, "id", max_broadcast=max_broadcast).collect()
    loose = voc.token_ids(docs, part, "id", strict=False, max_broadcast=max_broadcast)
    assert {r.id: r.token_ids for r in loose.collect()} == {1: [1, 0, 1], 2: [], 3: [None]}


def test_equal_vectors_far_from_the_origin_are_at_zero(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(50, 8)) * 1e4
    rows = [(i, [float(x) for x in base[i % 25]]) for i in range(50)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    queries = corpus.where("doc_id < 25").withColumnRenamed("doc_id", "query_id")
    for most in (100, 0):
        got = op.knn(queries, corpus, 2, max_broadcast_queries=most).collect()
        assert {(r.query_id, r.doc_id, r.distance, r["rank"]) for r in got} == {
            x for i in range(25) for x in ((i, i, 0.0, 1), (i, i + 25, 0.0, 2))
        }


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_few_pairs_are_measured(monkeypatch, metric, offset):
    measured = []
    exact = op._Best._exact
    monkeypatch.setattr(op._Best, "_exact", lambda self, q, d: measured.append(len(q)) or exact(self, q, d))
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 16)) + (offset if metric == "l2" else 0)
    data[1000:2000] = data[7]
    ids = rng.permutation(3000)
    best = op._Best(data[:300], 4, metric)
    for at in range(0, 3000, 1700):
        best.add(ids[at : at + 1700], data[at : at + 1700])
    unit = data if metric == "l2" else op._unit(data)
    for q in range(300):
        dist = ((unit - unit[q]) ** 2).sum(axis=1) if metric == "l2" else np.maximum(1 - unit @ unit[q], 0)
        dist = np.round(dist, 9)
        assert best.ids[q].tolist() == ids[np.lexsort((ids, dist))[:4]].tolist()
    assert sum(measured) < 300 * 3000 / 20


def test_distances_that_are_no_numbers_come_last():
    best = op._Best(np.array([[np.nan, 1.0], [0.0, 0.0]]), 3, "l2")
    best.add(np.array([3, 1, 2]), np.array([[1.0, 1], [np.nan, 0], [2, 2]]))
    assert best.ids.tolist() == [[1, 2, 3], [3, 2, 1]]
    best.add(np.array([0]), np.array([[5.0, 5.0]]))
    assert best.ids.tolist() == [[0, 1, 2], [3, 2, 0]]


def test_blocks_keep_the_cores_busy_within_bounds(spark):
    cores = spark.sparkContext.defaultParallelism
    assert op.blocks_per_side(spark, 500) == 1
    assert op.TASKS_PER_CORE * cores <= op.blocks_per_side(spark, 100_000) ** 2 < 2 * op.TASKS_PER_CORE * cores
    assert op.blocks_per_side(spark, 10_000_000) == -(-10_000_000 // op.MOST_BLOCK_ROWS)


def test_token_ids_by_join_keep_rows_that_share_a_key(spark):
    rows = [(1, ["a", "b", "a", None]), (1, ["b"]), (1, ["b"]), (2, []), (3, None), (None, ["c", "a"])]
    docs = spark.createDataFrame(rows, "k long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 10), ("b", 11)], "token string, token_id long")
    want = [(1, [10, 11, 10, None]), (1, [11]), (1, [11]), (2, []), (3, None), (None, [None, 10])]
    for most in (100, 1):
        got = voc.token_ids(docs, vocab, "k", strict=False, max_broadcast=most).collect()
        assert sorted(map(str, got)) == sorted(f"Row(k={k}, token_ids={t})" for k, t in want)
