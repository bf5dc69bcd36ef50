"""Exact search of many queries against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pivots
from tests.test_ivf import clustered, frame, nearest


def result(hits) -> set:
    return {(r.query_id, r.doc_id, r.rank) for r in hits.collect()}


@pytest.mark.parametrize("query_rows", [65_536, 30])
def test_neighbours_of_all_rows(spark, monkeypatch, query_rows):
    monkeypatch.setattr(pivots, "QUERY_ROWS", query_rows)
    data = clustered(6, 500, 6)
    # A third are copies of one vector.
    data[100:270] = data[3]
    found = pivots.knn_pivots(frame(spark, data), frame(spark, data).repartition(5), 4, "id", "id", "v", piece_rows=40)
    assert result(found.hits) == {(q, d, r) for q in range(500) for r, d in enumerate(nearest(data, q, 4), 1)}
    met = {r["query_id"]: r["pieces"] for r in found.met.collect()}
    assert sorted(met) == list(range(500)) and found.pieces >= 13
    assert all(1 <= n <= found.pieces for n in met.values())


def test_far_pieces_are_not_visited(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 4)) * 100
    data = (centres[np.arange(1000) % 20] + rng.normal(size=(1000, 4))).astype(np.float32)
    found = pivots.knn_pivots(frame(spark, data), frame(spark, data), 3, "id", "id", "v", piece_rows=50)
    assert result(found.hits) == {(q, d, r) for q in range(1000) for r, d in enumerate(nearest(data, q, 3), 1)}
    mean = found.met.agg(F.avg("pieces")).first()[0]
    assert mean < found.pieces / 5


def test_other_queries_more_than_there_are_documents(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(-2, 3, size=(60, 3)).astype(np.float32)
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(data)] + [(None, [0.0] * 3), ("n", None)], "q string, v array<float>")
    corpus = frame(spark, data[:5])
    found = pivots.knn_pivots(queries, corpus.withColumnRenamed("id", "d"), 9, "q", "d", "v", piece_rows=2)
    got = {}
    for r in found.hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    x = data.astype(np.float64)
    for i in range(60):
        dist = ((x[:5] - x[i]) ** 2).sum(axis=1)
        assert [d for _, d in sorted(got[f"q{i}"])] == sorted(range(5), key=lambda d: (dist[d], d))
    assert len(got) == 60


def test_empty_sides(spark):
    df = frame(spark, clustered(1, 20, 3))
    assert pivots.knn_pivots(df, df.limit(0), 2, "id", "id", "v").hits.collect() == []
    assert pivots.knn_pivots(df.limit(0), df, 2, "id", "id", "v").hits.collect() == []


def test_a_query_is_sent_once_per_region(spark, monkeypatch):
    """In many dimensions bounds leave every piece; a vector is not copied for each of them."""
    sent = []
    visits = pivots._visits
    monkeypatch.setattr(pivots, "_visits", lambda *a: sent.append(visits(*a)) or sent[-1])
    data = np.random.default_rng(3).normal(size=(300, 40)).astype(np.float32)
    df = frame(spark, data)
    found = pivots.knn_pivots(df, df, 2, "id", "id", "v", piece_rows=10)
    assert result(found.hits) == {(q, d, r) for q in range(300) for r, d in enumerate(nearest(data, q, 2), 1)}
    assert found.met.agg(F.avg("pieces")).first()[0] > 20
    # Fewer than 1024 rows are one region.
    assert [s.groupBy("query_id").count().agg(F.max("count")).first()[0] for s in sent] == [1, 1, 1]
