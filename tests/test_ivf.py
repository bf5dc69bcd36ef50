"""The inverted file against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ivf
from corpusloom.operators import retrieval as op
from corpusloom.session import scratch_path
from registry import retrieval


def frame(spark, data):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<float>")


def nearest(data: np.ndarray, q: int, k: int, ids=None) -> list[int]:
    x = data.astype(np.float64)
    dist = np.round(((x - x[q]) ** 2).sum(axis=1), 9)
    return sorted(range(len(x)) if ids is None else ids, key=lambda d: (dist[d], d))[:k]


def clustered(seed: int, n: int = 1500, dim: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)) + rng.normal(size=(25, dim))[rng.integers(0, 25, n)] * 3
    return data.astype(np.float32)


@pytest.mark.parametrize("max_broadcast", [10_000, 5])
def test_probed_lists_are_searched_exactly(spark, max_broadcast):
    """What is found is the exact answer among the vectors of the probed lists."""
    data = clustered(1, 400)
    data[100:220] = data[7]
    df = frame(spark, data).repartition(4)
    index = ivf.build_index(df, scratch_path(spark, "ivf"), "id", "v")
    assert sum(index.sizes) == len(data) and len(index.sizes) >= 10
    own = ivf.nearest_lists(data.astype(np.float64), index.centroids, 1)[:, 0]
    hits = ivf.search_index(df.where("id % 3 = 0"), index, 4, "id", "v", 3, max_broadcast, 40).collect()
    got: dict = {}
    for r in hits:
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    assert sorted(got) == list(range(0, 400, 3))
    for q, found in got.items():
        probed = set(ivf.nearest_lists(data[q : q + 1].astype(np.float64), index.centroids, 3)[0].tolist())
        assert [d for _, d in sorted(found)] == nearest(data, q, 4, [i for i in range(400) if own[i] in probed])


def test_all_lists_give_the_exact_neighbours(spark):
    data = clustered(2, 300)
    df = frame(spark, data)
    index = ivf.build_index(df, scratch_path(spark, "ivf"), "id", "v")
    index = ivf.load_index(ivf.save_index(index))
    every = len(index.sizes)
    for max_broadcast in (1000, 5):
        found = ivf.search_index(df, index, 4, "id", "v", every, max_broadcast, 50)
        want = {(q, d, r) for q in range(300) for r, d in enumerate(nearest(data, q, 4), 1)}
        assert {(x.query_id, x.doc_id, x.rank) for x in found.collect()} == want


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    """At least 0.9 of the true neighbours, without the query itself, which is trivially found."""
    vectors = retrieval._vectors(spark, f"/root/testdata/sf{sf}")
    queries = vectors.where("vec_id % 50 = 0")
    exact = op.knn(queries, vectors, 5, "l2", query_id="vec_id", doc_id="vec_id").where("query_id <> doc_id")
    want = {(r.query_id, r.doc_id) for r in exact.collect()}
    rows = retrieval.knn_ivf(spark, f"/root/testdata/sf{sf}").where("query_id <> doc_id").collect()
    got = {(r.query_id, r.doc_id) for r in rows}
    assert {q for q, _ in want} == {r.vec_id for r in queries.collect()}
    true = {(r.query_id, r.doc_id) for r in exact.where("rank <= 4").collect()}
    assert len(true & got) / len(true) >= 0.9


def test_rows_touched_grow_slower_than_the_table(spark):
    touched = []
    for n in (1500, 6000):
        data = clustered(3, n)
        index = ivf.build_index(frame(spark, data), scratch_path(spark, "ivf"), "id", "v")
        probed = ivf.nearest_lists(data[:200].astype(np.float64), index.centroids, index.probes)
        touched.append(np.mean(np.array(index.sizes)[probed].sum(axis=1)))
    assert touched[1] < 0.9 * 4 * touched[0] and touched[1] < 6000 / 10


def test_long_lists_are_split_and_a_list_of_copies_is_searched_in_blocks(spark):
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(1200, 6)) * 0.5
    data = np.vstack([dense, rng.normal(size=(40, 6)) * 200 + 1000]).astype(np.float32)
    df = frame(spark, data)
    sample = data[rng.permutation(len(data))[:60]].astype(np.float64)
    poor = ivf.train_centroids(np.vstack([sample[np.abs(sample).max(axis=1) > 100][:1], data[:1], data[-35:]]), 37)
    listed = ivf.with_list(df, "v", poor)
    sizes = ivf._counts(listed, len(poor))
    assert max(sizes) > 1000
    better = ivf._split_long(listed, "id", "v", poor, sizes)
    assert max(ivf._counts(ivf.with_list(df, "v", better), len(better))) < 400
    copies = np.vstack([np.ones((500, 6)), rng.normal(size=(500, 6))]).astype(np.float32)
    index = ivf.build_index(frame(spark, copies), scratch_path(spark, "ivf"), "id", "v")
    assert max(index.sizes) >= 500
    hits = ivf.search_index(frame(spark, copies), index, 3, "id", "v", None, 5, 64).where("query_id = 499").collect()
    assert sorted((r.doc_id, r.distance) for r in hits) == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [5.0, 5.0]), (None, [5.0, 5.0])], "id long, v array<float>")
    index = ivf.build_index(df, scratch_path(spark, "ivf"), "id", "v")
    hits = {(r.query_id, r.doc_id) for r in ivf.search_index(df, index, 4, "id", "v", len(index.sizes)).collect()}
    assert hits == {(q, d) for q in (1, 3, None) for d in (1, 3)}
    assert ivf.search_index(df.limit(0), index, 4, "id", "v").collect() == []
    nothing = ivf.build_index(df.limit(0), scratch_path(spark, "ivf"), "id", "v")
    assert ivf.search_index(df, nothing, 4, "id", "v").collect() == []


def test_only_probed_folders_are_read(spark):
    df = frame(spark, clustered(5, 400))
    index = ivf.build_index(df, scratch_path(spark, "ivf"), "id", "v")
    plan = ivf.search_index(df.where("id = 3"), index, 2, "id", "v", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan, plan
    assert ivf.search_index(df.where("id = 3"), index, 2, "id", "v", 1).agg(F.count(F.lit(1))).first()[0] == 2
