"""Exact nearest neighbours of many queries, pruned by distances to pivots.

Every vector of the corpus belongs to its nearest pivot. Ordered by pivot and distance to it, the corpus is cut
into pieces of equal size; a piece knows its pivot and the range of distances in it. By the triangle inequality
a query q cannot be nearer than max(|q p| - high, low - |q p|) to a piece of pivot p.

A query visits pieces by that bound, in three rounds: first as many as hold k vectors, then a few more, then all
whose bound does not exceed the k-th distance found so far. Neighbouring pieces make a region, and there are few
regions: a round sends a query once to each region in which it visits pieces, with their numbers, so where bounds leave
every piece, as in many dimensions, a vector is still copied once per region and not once per piece. The
corpus is not copied per query, but for regions that very many queries visit, where one copy serves ``QUERY_ROWS`` of
them. A task holds one region and lets its queries stream by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.common import explode_once
from corpusloom.operators import ivf, retrieval
from corpusloom.operators.prefix import starts_in_order
from corpusloom.session import checkpointed

#: Bounds of what tasks and driver know of the corpus: pivots and pieces.
MOST_PIVOTS = 1024
MOST_PIECES = 100_000
LEAST_PIECE_ROWS = 256
#: Queries that one copy of a region serves.
QUERY_ROWS = 16_384
#: Cells of the tables of queries and pieces that a task holds at a time.
_CELLS = 1 << 21
#: Pieces of the second round.
SECOND_ROUND = 4
#: More than the rounding error of a bound, relative to the distances it comes from.
SLACK = 1e-6


@dataclass(frozen=True)
class PivotSearch:
    """``hits``: query_id, doc_id, distance, rank. ``met``: query_id, pieces (visited). ``pieces`` of the corpus."""

    hits: DataFrame
    met: DataFrame
    pieces: int


@dataclass(frozen=True)
class _Pieces:
    """Numbers of the pieces, their pivots, ranges of distances and rows."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def visits(self, vectors: np.ndarray, kth: np.ndarray, k: int, stage: int) -> list[np.ndarray]:
        """The pieces each query visits in a round; ``kth`` is its k-th squared distance so far."""
        gaps = _distances(vectors, self.pivots)[:, self.pivot]
        bounds = np.maximum(np.maximum(gaps - self.high, self.low - gaps), 0.0)
        # Of pieces that a query may lie in the one with the nearer pivot comes first.
        order = np.lexsort((gaps, bounds), axis=1)
        held = np.cumsum(self.rows[order], axis=1)
        first = (held < k).sum(axis=1) + 1
        sorted_bounds = np.take_along_axis(bounds, order, 1)
        reach = np.sqrt(kth) + SLACK * (1 + np.sqrt(kth) + gaps.max(axis=1))
        near = (sorted_bounds <= reach[:, None]).sum(axis=1)
        if stage == 0:
            return [o[:f] for o, f in zip(order, first, strict=True)]
        if stage == 1:
            return [o[f : min(n, f + SECOND_ROUND)] for o, f, n in zip(order, first, near, strict=True)]
        return [o[f + SECOND_ROUND : n] for o, f, n in zip(order, first, near, strict=True)]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a part of the rows at a time."""
    out = np.empty((len(x), len(pivots)))
    step = max(1, 2_000_000 // max(1, pivots.size))
    for at in range(0, len(x), step):
        apart = x[at : at + step, None, :] - pivots[None]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
    return out


def _cut(corpus: DataFrame, piece_rows: int | None) -> tuple[DataFrame, _Pieces]:
    """The corpus with the number of the piece of every row, stored, and the pieces."""
    n = corpus.count()
    rows = piece_rows or max(LEAST_PIECE_ROWS, round(n**0.5))
    rows = max(rows, -(-n // MOST_PIECES))
    count = max(1, min(MOST_PIVOTS, -(-n // rows)))
    share = ivf.SAMPLED_PER_LIST * count / max(n, 1)
    sample = ivf._sample(ivf._drawn(corpus, "doc_id", share, "pivots"), "doc_id", "vector")
    if not len(sample):
        sample = ivf._sample(corpus.limit(1), "doc_id", "vector")
    pivots = ivf.train_centroids(sample, count)
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("pivot int, gap double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if vectors.empty:
            return pd.DataFrame({"pivot": pd.Series(dtype="int32"), "gap": pd.Series(dtype="float64")})
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        own = ivf.nearest_lists(x, shared.value, 1)[:, 0]
        apart = x - shared.value[own]
        return pd.DataFrame({"pivot": own.astype(np.int32), "gap": np.sqrt((apart * apart).sum(axis=1))})

    near = corpus.withColumn("__n", nearest("vector")).select("doc_id", "vector", "__n.pivot", "__n.gap")
    placed = starts_in_order(near.withColumn("__one", F.lit(1).cast("bigint")), ["pivot", "gap"], "__one", "__at")
    # A part of the order that spans two pivots is two pieces.
    part = F.floor(F.col("__at") / rows)
    stored = checkpointed(placed.select("doc_id", "vector", "pivot", "gap", part.alias("part")), "pieces")
    found = (
        stored.groupBy("part", "pivot")
        .agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("rows"))
        .toPandas()
        .sort_values(["part", "pivot"], ignore_index=True)
    )
    numbers = corpus.sparkSession.createDataFrame(
        [(int(p), int(v), i) for i, (p, v) in enumerate(zip(found["part"], found["pivot"], strict=True))],
        "part bigint, pivot int, piece int",
    )
    # At most one row per piece, and those are bounded.
    numbered = stored.join(F.broadcast(numbers), ["part", "pivot"]).select("doc_id", "vector", "piece")
    pieces = _Pieces(
        pivots, found["pivot"].to_numpy(), found["low"].to_numpy(), found["high"].to_numpy(), found["rows"].to_numpy()
    )
    return numbered, pieces


def _regions(pieces: _Pieces, count: int) -> np.ndarray:
    """The region of every piece: runs of pieces with about as many rows each."""
    before = np.cumsum(pieces.rows) - pieces.rows
    return (before * count // max(1, pieces.rows.sum())).astype(np.int32)


def _visits(queries: DataFrame, pieces: _Pieces, regions: np.ndarray, k: int, stage: int) -> DataFrame:
    """(query_id, vector, kth, region, pieces) for every region in which a query visits pieces in the round."""
    shared = queries.sparkSession.sparkContext.broadcast((pieces, regions))
    schema = T.StructType(
        [
            *queries.schema.fields,
            T.StructField("region", T.IntegerType()),
            T.StructField("pieces", T.ArrayType(T.IntegerType())),
        ]
    )

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, regions = shared.value
        step = max(1, _CELLS // len(regions))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                lists = pieces.visits(retrieval._matrix(batch["vector"]), batch["kth"].to_numpy(), k, stage)
                row = np.repeat(np.arange(len(batch)), [len(p) for p in lists])
                own = np.concatenate(lists).astype(np.int32)
                order = np.lexsort((own, row))
                row, own = row[order], own[order]
                if not len(own):
                    continue
                region = regions[own]
                starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(region) != 0)])
                offsets = pa.array(np.r_[starts, len(own)].astype(np.int32))
                columns = [c.take(pa.array(row[starts])) for c in batch.columns]
                found = [pa.array(region[starts]), pa.ListArray.from_arrays(offsets, pa.array(own))]
                yield pa.RecordBatch.from_arrays([*columns, *found], names=schema.names)

    return queries.mapInArrow(visited, schema)


def _meet(visits: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, distance): the k nearest in the visited pieces of every region, none farther than ``kth``."""
    askers = checkpointed(visits.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "askers")
    copies = askers.select("region", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("__copies"))
    tasks = max(1, copies.agg(F.coalesce(F.sum("__copies"), F.lit(0))).first()[0])
    copies = F.broadcast(copies)
    schema = T.StructType(
        [visits.schema["query_id"], corpus.schema["doc_id"], T.StructField("distance", T.DoubleType())]
    )
    alike = visits.schema["vector"].dataType == corpus.schema["vector"].dataType
    vector = F.col("vector") if alike else F.col("vector").cast("array<double>").alias("vector")
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    sides = (
        corpus.join(copies, "region")
        .select(
            "region", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("copy"), F.lit(0).alias("side"),
            nothing(visits, "query_id"), "doc_id", vector, F.lit(None).cast("double").alias("kth"),
            F.array("piece").alias("pieces"),
        )
        .unionByName(
            visits.join(copies, "region").select(
                "region", F.pmod(F.xxhash64("query_id"), F.col("__copies")).cast("int").alias("copy"),
                F.lit(1).alias("side"), "query_id", nothing(corpus, "doc_id"), vector, "kth", "pieces",
            )
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[tuple] = []
        names, docs = np.empty(0, object), {}
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("region", "copy", "side")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                region, copy, side = keys[start].tolist()
                if (region, copy) != held:
                    held, parts, docs = (region, copy), [], {}
                x = retrieval._matrix(part["vector"])
                if side == 0:
                    parts.append((retrieval._ids(part["doc_id"]), x, part["pieces"].flatten().to_numpy()))
                    continue
                if parts:
                    ids, vectors, owner = (np.concatenate(p) for p in zip(*parts, strict=True))
                    names, numbers = retrieval._codes(ids, ids[:0])
                    docs = {p: (numbers[owner == p], vectors[owner == p]) for p in np.unique(owner).tolist()}
                    parts = []
                places, distance = _in_pieces(x, part["kth"].to_numpy(), part["pieces"], docs, k)
                row, column = np.nonzero(np.isfinite(distance))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["query_id"].take(pa.array(row)),
                        pa.array(names[places[row, column]].tolist(), part["doc_id"].type),
                        pa.array(distance[row, column]),
                    ],
                    names=schema.names,
                )

    # Regions are small tables but long tasks, so the number of tasks is given and not found by size.
    dealt = sides.repartition(2 * tasks, "region", "copy").sortWithinPartitions("region", "copy", "side")
    return dealt.mapInArrow(search, schema)


def _in_pieces(
    x: np.ndarray, kth: np.ndarray, lists: pa.Array, docs: dict[int, tuple], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of the k nearest documents of every query in its pieces; infinite where there is none."""
    places, dist = np.zeros((len(x), k), np.int64), np.full((len(x), k), np.inf)
    asker, pieces = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    order = np.argsort(pieces, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(pieces[order])) + 1):
        own, (numbers, vectors) = asker[part], docs[int(pieces[part[0]])]
        best = retrieval._Best(x[own], k, "l2", kth[own])
        best.ids, best.dist = places[own], dist[own]
        best.add(numbers, vectors)
        places[own], dist[own] = best.ids, best.dist
    return places, dist


def knn_pivots(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    piece_rows: int | None = None,
) -> PivotSearch:
    """Exact k nearest documents of every query by squared Euclidean distance; ties go to the smaller id.

    Query ids are unique. Rows without id or vector take no part.
    """
    sides = []
    for df, key, name in ((queries, query_id, "query_id"), (corpus, doc_id, "doc_id")):
        side = df.select(F.col(key).alias(name), F.col(vector).alias("vector"))
        sides.append(side.where(F.col(name).isNotNull() & F.col("vector").isNotNull()))
    asked, c = sides
    if c.isEmpty():
        nothing = asked.limit(0).selectExpr("query_id", f"cast(null as {c.schema['doc_id'].dataType.simpleString()}) doc_id", "0D distance")
        return PivotSearch(retrieval._ranked(nothing, k), asked.selectExpr("query_id", "0L pieces"), 0)
    stored, pieces = _cut(c, piece_rows)
    asked = checkpointed(asked, "queries")
    spark = corpus.sparkSession
    regions = _regions(pieces, retrieval.blocks_per_side(spark, int(pieces.rows.sum())))
    numbers = spark.createDataFrame([(i, int(r)) for i, r in enumerate(regions)], "piece int, region int")
    stored = stored.join(F.broadcast(numbers), "piece")
    hits, met = None, None
    for stage in range(3):
        kth: Column = F.lit(float("inf"))
        state = asked.withColumn("kth", kth)
        if hits is not None:
            # The round before has given every query as many as k, if the corpus holds so many.
            last = hits.where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
            state = asked.join(last, "query_id", "left").fillna(float("inf"), "kth")
        visits = checkpointed(_visits(state, pieces, regions, k, stage), "visits")
        found = _meet(visits, stored, k)
        found = found if hits is None else found.unionByName(hits.drop("rank"))
        hits = checkpointed(retrieval._ranked(found, k), "hits")
        seen = visits.select("query_id", F.size("pieces").cast("bigint").alias("pieces"))
        met = seen if met is None else met.unionByName(seen)
    counts = met.groupBy("query_id").agg(F.sum("pieces").alias("pieces"))
    return PivotSearch(hits, counts, len(pieces.rows))
