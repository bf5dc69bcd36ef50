"""Nearest neighbours.

Distances are computed block-wise with numpy inside the tasks, and a task passes on only the k
best of what it has seen, so no candidate pair ever becomes a row. Distances are rounded to
9 places and ties are broken by id, which makes results independent of block sizes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.common import explode_once
from corpusloom.functions.rng import uniform_value

# Queries up to this number are broadcast; their count is checked before.
MAX_BROADCAST_QUERIES = 4096
# Rows per side of one block when both sides are large.
BLOCK_ROWS = 8192
# Rows of a block when every query meets every document: as many as keep the cores busy, within these bounds.
LEAST_BLOCK_ROWS, MOST_BLOCK_ROWS = 1024, 65_536
TASKS_PER_CORE = 8
DIGITS = 9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """list<float> column as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object) if column.null_count else column.to_numpy(zero_copy_only=False)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


#: More than the relative rounding error of a fast score of up to some hundred components.
_FAST_ERROR = {np.dtype(np.float32): 2e-5, np.dtype(np.float64): 1e-12}
#: Rows of queries and of documents that meet in one product of matrices; pairs measured exactly at a time.
_QUERY_TILE, _DOC_TILE, _PAIRS = 1024, 4096, 1 << 16
_FIRST_TILE = 512
#: Squares up to this fit single precision.
_MOST_FAST = 1e30
#: Pairs per query beyond which a tile is scored again in double precision.
_MANY = 64


def _codes(ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names in order, their numbers): numbers of ``ids`` and then of ``known`` compare as the ids do."""
    every = np.concatenate([ids, known.ravel()]) if known.size else ids
    if every.dtype != object:
        return np.unique(every, return_inverse=True)
    names = sorted(set(every.tolist()), key=lambda v: (v is None, 0 if v is None else v))
    place = {v: i for i, v in enumerate(names)}
    return np.array(names, dtype=object), np.fromiter((place[v] for v in every), np.int64, len(every))


def _first_copies(docs: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Places of the documents that may be among the k nearest: of equal vectors the k with the smallest ids."""
    rows = np.ascontiguousarray(docs + 0.0)
    alike = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    if alike.max(initial=-1) + 1 == len(docs):
        return np.argsort(codes, kind="stable")
    order = np.lexsort((codes, alike))
    return np.sort(order[_places(alike[order]) < k])


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each element among its equals, from 0."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


class _Best:
    """The k nearest documents of each query among all blocks added so far.

    A product of matrices in single precision scores all pairs of a tile. Those whose score may belong to the k
    nearest, by a bound of its rounding error, are few; they are measured in double precision by differences.
    Distances that are no finite numbers come last.

    With ``limit``, a distance for each query, what is farther is of no interest: places that are left then have an
    infinite distance.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None):
        if metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric {metric}")
        self.queries, self.k, self.metric = _unit(queries) if metric == "cosine" else queries, k, metric
        self.limit = limit
        self.ids = np.empty((len(queries), 0), dtype=object)
        self.dist = np.empty((len(queries), 0))

    def add(self, ids: np.ndarray, docs: np.ndarray) -> None:
        if not len(ids) or not len(self.queries) or not self.k:
            return
        docs = _unit(docs) if self.metric == "cosine" else docs
        n, old = len(ids), self.ids.shape[1]
        names, codes = _codes(ids, self.ids)
        known = codes[n:].reshape(self.dist.shape)
        dist, places = (np.full((len(self.queries), self.k), x) for x in (np.inf, len(names)))
        measured = np.isfinite(self.dist)
        dist[:, :old], places[:, :old] = np.where(measured, self.dist, np.inf), np.where(measured, known, len(names))
        kept = _first_copies(docs, codes[:n], self.k)
        docs, codes = docs[kept], codes[:n][kept]
        finite = np.isfinite(docs).all(axis=1)
        near, own = docs[finite], codes[finite]
        middle = near.mean(axis=0) if self.metric == "l2" and len(near) else np.zeros(docs.shape[1])
        for at in range(0, len(self.queries), _QUERY_TILE):
            rows = slice(at, at + _QUERY_TILE)
            limit = None if self.limit is None else self.limit[rows]
            self._scan(self.queries[rows], near, own, middle, dist[rows], places[rows], limit)
        found = min(self.k, old + n)
        if self.limit is None:
            for q in np.flatnonzero(~np.isfinite(dist[:, :found]).all(axis=1)):
                every = np.concatenate([self.dist[q], self._exact(self.queries[[q]].repeat(len(docs), axis=0), docs)])
                code = np.concatenate([known[q], codes])
                order = np.lexsort((code, every))[:found]
                dist[q, :found], places[q, :found] = every[order], code[order]
        self.ids, self.dist = names[np.minimum(places[:, :found], len(names) - 1)], dist[:, :found]

    def _scan(
        self, q: np.ndarray, docs: np.ndarray, codes: np.ndarray, middle: np.ndarray, dist: np.ndarray,
        places: np.ndarray, limit: np.ndarray | None,
    ) -> None:
        """Take the documents into ``dist`` and ``places``, the k nearest of the queries ``q`` in order."""
        # A short tile first: without a k-th distance yet its scores are partitioned.
        cuts = [0, *range(min(_FIRST_TILE, len(docs)), len(docs), _DOC_TILE), len(docs)]
        for at, end in itertools.pairwise(cuts):
            d, own = docs[at:end], codes[at:end]
            kth = dist[:, -1] if limit is None else np.minimum(dist[:, -1], limit)
            for kind in (np.float32, np.float64):
                row, column = self._near(q, d, middle, kth, np.dtype(kind))
                if len(row) <= _MANY * len(q):
                    break
            exact = np.empty(len(row))
            for i in range(0, len(row), _PAIRS):
                part = slice(i, i + _PAIRS)
                exact[part] = self._exact(q[row[part]], d[column[part]])
            code = own[column]
            better = (exact < dist[row, -1]) | ((exact == dist[row, -1]) & (code < places[row, -1]))
            row, exact, code = row[better], exact[better], code[better]
            if not len(row):
                continue
            touched = np.unique(row)
            row = np.concatenate([np.repeat(touched, self.k), row])
            exact = np.concatenate([dist[touched].ravel(), exact])
            code = np.concatenate([places[touched].ravel(), code])
            order = np.lexsort((code, exact, row))
            order = order[_places(row[order]) < self.k]
            dist[touched], places[touched] = exact[order].reshape(-1, self.k), code[order].reshape(-1, self.k)

    def _near(
        self, q: np.ndarray, d: np.ndarray, middle: np.ndarray, kth: np.ndarray, kind: np.dtype
    ) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of all pairs in the tile that may be as near as ``kth`` or among the k nearest of it."""
        q, d = q - middle, d - middle
        if self.metric == "l2":
            own, length = (q * q).sum(axis=1), (d * d).sum(axis=1)
            scores = np.hstack([-2 * q, np.ones((len(q), 1))]).astype(kind) @ np.hstack([d, length[:, None]]).astype(kind).T
            reach = 2 * np.sqrt(own * length.max()) + own + length.max()
        else:
            own = np.ones(len(q))
            scores = (-q).astype(kind) @ d.astype(kind).T
            reach = np.full(len(q), 2.0)
        if kind == np.float32 and not np.nanmax(reach, initial=0) < _MOST_FAST:
            return self._near(q + middle, d + middle, middle, kth, np.dtype(np.float64))
        slack = 1e-8 + _FAST_ERROR[kind] * reach
        border = kth - own + slack
        open_ = np.flatnonzero(~np.isfinite(kth))
        if len(open_):
            nearest = scores[open_]
            if len(d) > self.k:
                nearest = np.partition(nearest, self.k - 1, axis=1)[:, : self.k]
            border[open_] = nearest.max(axis=1) + 2 * slack[open_]
        # Rounded up, as the border passes into the precision of the scores.
        border = np.nextafter(border.astype(kind), kind.type(np.inf))
        flat = np.flatnonzero(scores <= border[:, None])
        return flat // len(d), flat % len(d)

    def _exact(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Distances of pairs by differences: the fast form loses digits, so equal vectors would not be at 0."""
        if self.metric == "l2":
            apart = q - d
            return np.round(np.einsum("ij,ij->i", apart, apart), DIGITS) + 0.0
        return np.round(np.maximum(1.0 - np.einsum("ij,ij->i", q, d), 0.0), DIGITS) + 0.0


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return candidates.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _sides(
    queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, vector: str
) -> tuple[DataFrame, DataFrame]:
    return (
        queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")),
        corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vector")),
    )


def _types(q: DataFrame, c: DataFrame) -> tuple[str, str]:
    return q.schema["query_id"].dataType.simpleString(), c.schema["doc_id"].dataType.simpleString()


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    metric: str = "l2",
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Exact k nearest documents per query: (query_id, doc_id, distance, rank).

    ``metric``: 'l2' (squared) or 'cosine'. With few queries the corpus is scanned once, in place,
    and at most k rows per query and task are shuffled. With more queries both sides are cut into
    blocks that meet pairwise, each pair of blocks in a task of its own.
    """
    q, c = _sides(queries, corpus, query_id, doc_id, vector)
    if q.limit(max_broadcast_queries + 1).count() > max_broadcast_queries:
        return _knn_blocks(q, c, k, metric)

    q_type, c_type = _types(q, c)
    table = q.toArrow()
    if table.num_rows == 0:
        nothing = c.limit(0).selectExpr(f"cast(null as {q_type}) query_id", "doc_id", "0D distance")
        return _ranked(nothing, k)
    shared = corpus.sparkSession.sparkContext.broadcast(
        (table["query_id"].to_pylist(), _matrix(table["vector"]))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        best = _Best(vectors, k, metric)
        for batch in batches:
            if batch.num_rows:
                best.add(_ids(batch["doc_id"]), _matrix(batch["vector"]))
        found = best.ids.shape[1]
        yield pa.RecordBatch.from_pandas(
            pd.DataFrame(
                {
                    "query_id": np.repeat(np.array(query_ids, dtype=object), found),
                    "doc_id": best.ids.ravel(),
                    "distance": best.dist.ravel(),
                }
            ),
            schema=arrow_schema,
        )

    arrow_schema = pa.schema(
        [table.schema.field("query_id"), pa.field("doc_id", c.limit(0).toArrow().schema.field("doc_id").type)]
        + [pa.field("distance", pa.float64())]
    )
    partial = c.mapInArrow(scan, f"query_id {q_type}, doc_id {c_type}, distance double")
    return _ranked(partial, k)


def _block_count(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def _block_search(k: int, metric: str) -> Callable:
    def search(_key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        best = _Best(np.stack(q["vector"].to_numpy()).astype(np.float64), k, metric)
        best.add(
            c["doc_id"].to_numpy(), np.stack(c["vector"].to_numpy()).astype(np.float64)
        )
        found = best.ids.shape[1]
        return pd.DataFrame(
            {
                "query_id": np.repeat(q["query_id"].to_numpy().astype(object), found),
                "doc_id": best.ids.ravel(),
                "distance": best.dist.ravel(),
            }
        )

    return search


def _block_of(key: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(key), count).cast("int")


def blocks_per_side(spark: SparkSession, rows: int) -> int:
    """Blocks to cut ``rows`` into whose pairs keep all cores busy; more only where a block would be too long."""
    wanted = math.isqrt(TASKS_PER_CORE * spark.sparkContext.defaultParallelism) + 1
    return max(_block_count(rows, MOST_BLOCK_ROWS), min(wanted, _block_count(rows, LEAST_BLOCK_ROWS)))


def _knn_blocks(
    q: DataFrame, c: DataFrame, k: int, metric: str, block_rows: int | None = None
) -> DataFrame:
    """Every block of queries meets every block of documents, in a task of its own.

    A row is copied once per block of the other side, which a table of up to millions of rows has few of.
    """
    spark = q.sparkSession
    q_blocks, c_blocks = (
        _block_count(n, block_rows) if block_rows else blocks_per_side(spark, n) for n in (q.count(), c.count())
    )
    left = q.withColumn("qb", _block_of(F.col("query_id"), F.lit(q_blocks))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )
    right = c.withColumn("cb", _block_of(F.col("doc_id"), F.lit(c_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    schema = T.StructType([q.schema["query_id"], c.schema["doc_id"], T.StructField("distance", T.DoubleType())])

    def search(asked: pa.Table, corpus: pa.Table) -> pa.Table:
        types = asked.schema.field("query_id").type, corpus.schema.field("doc_id").type
        best = _Best(_matrix(asked["vector"]) if len(asked) else np.zeros((0, 0)), k, metric)
        if len(asked) and len(corpus):
            best.add(_ids(corpus["doc_id"]), _matrix(corpus["vector"]))
        found = pa.array(np.repeat(np.arange(len(asked)), best.ids.shape[1]))
        return pa.table(
            [
                asked["query_id"].take(found).cast(types[0]),
                pa.array(best.ids.ravel().tolist(), types[1]),
                pa.array(best.dist.ravel(), pa.float64()),
            ],
            names=schema.names,
        )

    # The blocks are small tables but long tasks, so their number is given and not found by size.
    sides = [df.repartition(q_blocks * c_blocks, "qb", "cb").groupBy("qb", "cb") for df in (left, right)]
    return _ranked(sides[0].cogroup(sides[1]).applyInArrow(search, schema), k)


def lsh_buckets(vector: Column, dim: int, bands: int, bits: int, seed: int = 0) -> Column:
    """array<int>: the bucket of a vector in each band.

    A bit tells on which side of a seeded hyperplane the vector lies.
    """
    planes = hyperplanes(dim, bands, bits, seed)

    @F.pandas_udf("array<int>")
    def buckets(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        sides = np.stack(vectors.to_numpy()).astype(np.float64) @ planes.T > 0
        codes = sides.reshape(len(vectors), bands, bits) @ (1 << np.arange(bits))
        return pd.Series(list(codes.astype(np.int32)))

    return buckets(vector)


def hyperplanes(dim: int, bands: int, bits: int, seed: int = 0) -> np.ndarray:
    """Seeded plane normals with components uniform in [-0.5, 0.5), one row per band and bit."""
    return np.array(
        [
            [uniform_value("plane", band, bit, d, seed=seed) - 0.5 for d in range(dim)]
            for band in range(bands)
            for bit in range(bits)
        ]
    )


def knn_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    metric: str = "l2",
    dim: int = 64,
    bands: int = 4,
    bits: int = 4,
    seed: int = 0,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate k nearest: exact ranking of all documents that share a bucket with the query.

    Buckets are counted first. Those without a partner are dropped before the shuffle, and a large
    one is cut into blocks on both sides that meet pairwise, so its size does not matter. All
    documents of a shared bucket are considered.
    """
    q, c = _sides(queries, corpus, query_id, doc_id, vector)
    q_type, c_type = _types(q, c)

    def bucketed(df: DataFrame) -> DataFrame:
        codes = lsh_buckets(F.col("vector"), dim, bands, bits, seed)
        return explode_once(
            df.withColumn("__codes", codes), F.col("__codes"), *df.columns, pos="band", value="bucket"
        )

    def blocks(df: DataFrame, name: str) -> DataFrame:
        rows = df.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("rows"))
        return rows.select("band", "bucket", F.ceil(F.col("rows") / block_rows).cast("int").alias(name))

    left, right = bucketed(q), bucketed(c)
    # at most bands * 2**bits rows, whatever the size of the data
    plan = F.broadcast(blocks(left, "q_blocks").join(blocks(right, "c_blocks"), ["band", "bucket"]))

    def spread(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return (
            df.join(plan, ["band", "bucket"])
            .withColumn(own, _block_of(F.col(key), F.col(own_n)))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("q_blocks", "c_blocks")
        )

    keys = ["band", "bucket", "qb", "cb"]
    partial = (
        spread(left, "query_id", "qb", "q_blocks", "cb", "c_blocks")
        .groupBy(*keys)
        .cogroup(spread(right, "doc_id", "cb", "c_blocks", "qb", "q_blocks").groupBy(*keys))
        .applyInPandas(
            _block_search(k, metric), f"query_id {q_type}, doc_id {c_type}, distance double"
        )
    )
    # a pair found in several bands has the same distance each time
    return _ranked(partial.dropDuplicates(["query_id", "doc_id"]), k)


def stuff_context(
    hits: DataFrame, content: str = "content", sep: str = "\n\n", by: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """One row per query with the contents of its hits, nearest first. Hits are at most k per query."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col(content).alias("content"))))
    return hits.groupBy(*by).agg(
        F.array_join(F.transform(ordered, lambda h: h["content"]), sep).alias("context")
    )


