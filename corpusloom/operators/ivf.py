"""Approximate nearest neighbours from an inverted file with trained centroids.

A bounded sample trains centroids; their number grows with the square root of the table. Every vector is
stored in the list of its nearest centroid, one folder per list, so a search reads the folders of the lists it
probes and no others. Lists that come out long are split by centroids trained on a sample of their own; what
stays long, as a list of equal vectors does, is searched in blocks. Candidates are ranked by exact
distances.

How many lists are probed is measured: for a bounded sample of rows the exact neighbours are searched in the whole
table, and the number of lists is the smallest that would have found the asked share of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.common import explode_once
from corpusloom.operators import retrieval
from corpusloom.session import checkpointed

#: Bounds of what the driver trains with: lists, and sampled rows per list.
MOST_LISTS = 4096
SAMPLED_PER_LIST = 64
TRAINING_ROUNDS = 12
#: A list longer than so many times the mean is split.
LONG = 4
#: Rows whose exact neighbours say how many lists to probe, and the share of them to be found.
CALIBRATION_ROWS = 256
TARGET = 0.95
#: Queries that are broadcast; more meet the lists in tasks of limited size.
MAX_BROADCAST_QUERIES = retrieval.MAX_BROADCAST_QUERIES
BLOCK_ROWS = retrieval.BLOCK_ROWS


@dataclass(frozen=True)
class Index:
    """Where the vectors are, the centroid and size of every list, and the number of lists to probe."""

    path: str
    centroids: np.ndarray
    sizes: list[int]
    probes: int


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first; ties go to the smaller number."""
    distance = (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T
    if n >= len(centroids):
        return np.argsort(distance, axis=1, kind="stable")
    some = np.sort(np.argpartition(distance, n - 1, axis=1)[:, :n], axis=1)
    order = np.argsort(np.take_along_axis(distance, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def train_centroids(sample: np.ndarray, lists: int, rounds: int = TRAINING_ROUNDS) -> np.ndarray:
    """Means of the sample's parts by repeated assignment; the first distinct rows begin."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centroids = sample[np.sort(first)[:lists]].copy()
    for _ in range(rounds):
        owner = np.concatenate(
            [nearest_lists(sample[i : i + 4096], centroids, 1)[:, 0] for i in range(0, len(sample), 4096)]
        )
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        counts = np.bincount(owner, minlength=len(centroids))
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def _drawn(df: DataFrame, key: str, share: Column | float, salt: str) -> DataFrame:
    """Rows by a hash of their key: the same in every run, ``share`` of them in expectation."""
    draw = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)
    return df.where(draw < share)


def _sample(df: DataFrame, key: str, vector: str) -> np.ndarray:
    """A drawn frame on the driver, in the order of a hash."""
    table = df.select(vector, F.xxhash64(key).alias("h")).orderBy("h", vector).toArrow()
    return retrieval._matrix(table[vector]) if table.num_rows else np.zeros((0, 0))


def with_list(df: DataFrame, vector: str, centroids: np.ndarray, out: str = "list") -> DataFrame:
    """``df`` with the list of each vector."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.IntegerType())
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="int32")
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(nearest_lists(x, shared.value, 1)[:, 0].astype(np.int32))

    return df.withColumn(out, nearest(vector))


def _counts(df: DataFrame, lists: int) -> list[int]:
    sizes = [0] * lists
    for row in df.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[row["list"]] = row["n"]
    return sizes


def _split_long(rows: DataFrame, doc_id: str, vector: str, centroids: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Centroids in which those of long lists are replaced by several, trained on rows of that list."""
    mean = sum(sizes) / len(sizes)
    long = {i: -(-n // max(1, round(mean))) for i, n in enumerate(sizes) if n > LONG * mean}
    if not long:
        return centroids
    share = F.lit(0.0)
    for i, parts in long.items():
        share = F.when(F.col("list") == i, min(1.0, SAMPLED_PER_LIST * parts / sizes[i])).otherwise(share)
    # The parts of all long lists are fewer than the lists, so this is bounded as the first sample is.
    picked = _drawn(rows.where(F.col("list").isin(list(long))), doc_id, share, "split")
    table = picked.select("list", vector, F.xxhash64(doc_id).alias("h")).orderBy("h", vector).toArrow()
    owner, x = table["list"].to_numpy(), retrieval._matrix(table[vector]) if table.num_rows else np.zeros((0, 0))
    kept = [c[None] for i, c in enumerate(centroids) if i not in long or not (owner == i).any()]
    return np.concatenate([*kept, *[train_centroids(x[owner == i], n) for i, n in long.items() if (owner == i).any()]])


def build_index(
    corpus: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    vector: str = "embedding",
    k: int = 4,
    target: float = TARGET,
    lists: int | None = None,
) -> Index:
    """Train, store all vectors by list below ``path``, and measure how many lists to probe.

    Rows without id or vector are not indexed. ``lists`` is the square root of the number of rows unless given. Distances are
    squared Euclidean ones.
    """
    rows = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vector"))
    rows = rows.where("vector is not null and doc_id is not null")
    n = rows.count()
    lists = max(1, min(MOST_LISTS, round(n**0.5) if lists is None else lists))
    sample = _sample(_drawn(rows, "doc_id", SAMPLED_PER_LIST * lists / max(n, 1), "train"), "doc_id", "vector")
    if not len(sample):
        sample = _sample(rows.limit(1), "doc_id", "vector")
    if not len(sample):
        # Nothing is stored, and a search finds nothing.
        return Index(path, np.zeros((1, 0)), [0], 1)
    centroids = train_centroids(sample, lists)
    listed = with_list(rows, "vector", centroids)
    centroids = _split_long(listed, "doc_id", "vector", centroids, _counts(listed, len(centroids)))
    # A list's rows go to as many tasks as it has blocks; the estimate is that of the split lists.
    dealt = with_list(rows, "vector", centroids).withColumn("__deal", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    dealt.repartition("list", "__deal").drop("__deal").write.partitionBy("list").parquet(path)
    stored = _stored(corpus.sparkSession, path)
    index = Index(path, centroids, _counts(stored, len(centroids)), len(centroids))
    return Index(path, centroids, index.sizes, _probes(stored, index, n, k, target))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("list", F.col("list").cast("int"))


def _probes(stored: DataFrame, index: Index, n: int, k: int, target: float) -> int:
    """The fewest lists that hold the asked share of the exact neighbours of sampled rows, themselves left out."""
    queries = _drawn(stored, "doc_id", CALIBRATION_ROWS / max(n, 1), "probe").select("doc_id", "vector")
    # Bounded in expectation by the draw, and in any case by what may be broadcast.
    queries = checkpointed(queries.orderBy(F.xxhash64("doc_id")).limit(4 * CALIBRATION_ROWS), "calibration")
    hits = retrieval.knn(queries, stored, k + 1, "l2", "doc_id", "doc_id", "vector")
    hits = hits.where(~F.col("query_id").eqNullSafe(F.col("doc_id"))).where(F.col("rank") <= k + 1)
    found = hits.select("query_id", "doc_id").join(F.broadcast(queries.withColumnRenamed("doc_id", "query_id")), "query_id")
    lists = F.broadcast(found.withColumnRenamed("vector", "asked")).join(stored.select("doc_id", "list"), "doc_id")
    table = lists.select("asked", "list").toArrow()
    if not table.num_rows:
        return len(index.sizes)
    order = nearest_lists(retrieval._matrix(table["asked"]), index.centroids, len(index.sizes))
    place = np.argmax(order == table["list"].to_numpy()[:, None], axis=1)
    return int(np.sort(place)[max(int(np.ceil(target * len(place))) - 1, 0)]) + 1


def search_index(
    queries: DataFrame,
    index: Index,
    k: int = 4,
    query_id: str = "query_id",
    vector: str = "embedding",
    probes: int | None = None,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, doc_id, distance, rank): the nearest among the vectors of the probed lists.

    With few queries the folders that any of them probes are scanned in place. With more, queries and vectors meet
    by list, a long list in blocks.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")).where("vector is not null")
    n = min(probes or index.probes, len(index.sizes))
    if not index.centroids.size:
        return retrieval._ranked(asked.limit(0).selectExpr("query_id", "query_id doc_id", "0D distance"), k)
    stored = _stored(spark, index.path)
    few = asked.limit(max_broadcast_queries + 1).count() <= max_broadcast_queries
    search = _scan if few else _meet
    return retrieval._ranked(search(asked, stored, index, n, k, block_rows), k)


def _schema(asked: DataFrame, stored: DataFrame) -> T.StructType:
    return T.StructType(
        [
            asked.schema["query_id"],
            stored.schema["doc_id"],
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _scan(
    asked: DataFrame, stored: DataFrame, index: Index, probes: int, k: int, _block_rows: int
) -> DataFrame:
    table = asked.toArrow()
    schema = _schema(asked, stored)
    if not table.num_rows:
        return stored.sparkSession.createDataFrame([], schema)
    x = retrieval._matrix(table["vector"])
    lists = nearest_lists(x, index.centroids, probes)
    askers = {int(i): np.flatnonzero((lists == i).any(axis=1)) for i in np.unique(lists)}
    shared = stored.sparkSession.sparkContext.broadcast((table["query_id"], x, askers))
    # Folder names: only these are opened.
    probed = stored.where(F.col("list").isin(sorted(askers)))
    types = [table.schema.field("query_id").type, stored.limit(0).toArrow().schema.field("doc_id").type]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, askers = shared.value
        best: dict[int, retrieval._Best] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = batch["list"].to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(object)
            docs = retrieval._matrix(batch["vector"])
            for i in np.unique(owner).tolist():
                if i not in best:
                    best[i] = retrieval._Best(vectors[askers[i]], k, "l2")
                best[i].add(ids[owner == i], docs[owner == i])
        for i, b in best.items():
            found = b.ids.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array(np.repeat(askers[i], found))).combine_chunks().cast(types[0]),
                    pa.array(b.ids.ravel().tolist(), types[1]),
                    pa.array(b.dist.ravel()),
                ],
                names=schema.names,
            )

    return probed.select("doc_id", "vector", "list").mapInArrow(scan, schema)


def _meet(asked: DataFrame, stored: DataFrame, index: Index, probes: int, k: int, block_rows: int) -> DataFrame:
    shared = stored.sparkSession.sparkContext.broadcast(index.centroids)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lists(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(list(nearest_lists(x, shared.value, probes).astype(np.int32)))

    left = explode_once(
        asked.withColumn("__lists", lists("vector")), F.col("__lists"), "query_id", "vector", value="list"
    ).drop("pos")
    # One row per list and block number; the lists are bounded and so are the blocks per list for a given table.
    counts = left.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("q_blocks"))
    sizes = [(i, max(1, -(-n // block_rows))) for i, n in enumerate(index.sizes)]
    plan = checkpointed(
        stored.sparkSession.createDataFrame(sizes, "list int, c_blocks int").join(F.broadcast(counts), "list"), "lists"
    )
    plan = F.broadcast(plan)
    by = ["list", "qb", "cb"]
    q = left.join(plan, "list").select(
        "query_id", "vector", "list", retrieval._block_of(F.col("query_id"), F.col("q_blocks")).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("cb"),
    )
    c = stored.join(plan, "list").select(
        "doc_id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"),
        retrieval._block_of(F.col("doc_id"), F.col("c_blocks")).alias("cb"),
    )
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(
        retrieval._block_search(k, "l2"), _schema(asked, stored)
    )


def save_index(index: Index) -> str:
    """The index without its vectors as text, to be kept beside them."""
    return json.dumps(
        {"path": index.path, "centroids": index.centroids.tolist(), "sizes": index.sizes, "probes": index.probes}
    )


def load_index(text: str) -> Index:
    data = json.loads(text)
    return Index(data["path"], np.array(data["centroids"], dtype=np.float64), data["sizes"], data["probes"])
