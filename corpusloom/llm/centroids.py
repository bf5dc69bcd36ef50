"""Clusters of vectors by integer centroids, found by an equal-average equal-variance search.

Components become integers, floor(scale * x), and stay integers: distances, sums and means are exact, so the
result does not depend on how the rows are spread. A round assigns every vector to its nearest centroid and
replaces each centroid that has vectors by the floor of their mean, component by component.

The search sorts the centroids by component sum S. From the place of a vector's own sum it scans outwards,
always the nearer side first. With V = sqrt(k * sum(x * x) - S * S), the deviation times k, every centroid c has

    k * distance(x, c) >= (S_x - S_c) ** 2 + (V_x - V_c) ** 2.

When the first term alone exceeds k times the best distance so far, no centroid further out can be nearer and
the scan ends; when both terms do, that centroid is left out. What remains is measured in integers. A bound
equal to the best distance rejects nothing, and the bounds are compared with a margin above their rounding
error, so ties go to the centroid with the smaller number, as a plain search would decide.

Vectors with another number of components than asked, with a null or with a component that is not finite are
not kept; null vectors neither. A null key is kept, and its vector never is a first centroid while others are
left. Repeated rows each count. Of rows with equal keys the smaller vector comes first. Fewer vectors than
clusters give fewer centroids, an empty table none and no rows. A component whose squares might not fit 64 bits
fails the job (``largest``; 64 components with scale 1024: beyond 32,768). Of the columns of the table
only key and vector are read.

Per round a task reads its vectors in Arrow batches and gives one sum per centroid and component; these
partial sums are added by an exchange, and k * (components + 2) numbers reach the driver whatever the size of
the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh_name
from corpusloom.session import checkpointed

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: More than the relative rounding error of the bounds.
MARGIN = 1e-9
#: Rows measured at once.
ROWS = 8192

COUNT, INERTIA = -1, -2


def largest(components: int) -> int:
    """The largest absolute integer component: components * sum of squares then stays below 2 ** 63."""
    return min((1 << 31) // components, (1 << 31) - 1)


@dataclass(frozen=True)
class Clustering:
    """Centroids by number, and per centroid how many vectors it has and the sum of their distances."""

    centroids: np.ndarray
    counts: list[int]
    inertias: list[int]


def integer_vectors(
    df: DataFrame, key: str, vector: str, components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """The kept vectors as (key, packed): their integer components as little-endian 32-bit numbers."""
    packed = "packed"
    schema = T.StructType([df.schema[key], T.StructField(packed, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1)
            whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), components), False)
            keys, vectors = keys.filter(whole), vectors.filter(whole)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
            finite = np.isfinite(values).all(axis=1)
            integers = np.floor(values[finite] * scale)
            if integers.size and np.abs(integers).max() > largest(components):
                raise OverflowError(f"a component of a vector is beyond {largest(components) / scale}")
            width = 4 * components
            rows = integers.astype("<i4").tobytes()
            cells = [rows[i : i + width] for i in range(0, len(rows), width)]
            yield pa.RecordBatch.from_arrays(
                [keys.filter(pa.array(finite)), pa.array(cells, pa.binary())], names=[key, packed]
            )

    return df.select(key, vector).mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, key: str, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ``seed:key`` has the smallest sha256, in that order."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    drawn = vectors.select(draw.alias("draw"), "packed").orderBy(F.asc_nulls_last("draw"), "packed").limit(clusters)
    rows = [np.frombuffer(r["packed"], dtype="<i4") for r in drawn.collect()]
    return np.array(rows, dtype=np.int64) if rows else np.zeros((0, 0), np.int64)


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """k times the deviation of each row, from integers: k * sum of squares - square of the sum."""
    return np.sqrt((x.shape[1] * np.einsum("ij,ij->i", x, x) - sums * sums).astype(np.float64))


class Search:
    """Nearest of a few centroids, exactly."""

    def __init__(self, centroids: np.ndarray):
        self.k = centroids.shape[1]
        sums = centroids.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        self.number = order
        self.sorted = centroids[order]
        self.sums = sums[order]
        self.deviations = _deviation(self.sorted, self.sums)
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
        m, last = len(x), len(self.sums)
        sums = x.sum(axis=1)
        deviations = _deviation(x, sums)
        best = np.full(m, np.iinfo(np.int64).max)
        number = np.full(m, last)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        scanning = np.arange(m)
        while len(scanning):
            lo, hi, own = left[scanning], right[scanning], sums[scanning]
            far = np.iinfo(np.int64).max
            below = np.where(lo >= 0, own - self.sums[np.maximum(lo, 0)], far)
            above = np.where(hi < last, self.sums[np.minimum(hi, last - 1)] - own, far)
            down = below <= above
            at = np.where(down, lo, hi)
            gap = np.minimum(below, above)
            # Both terms of the bound; a distance never found yet is infinite.
            bar = np.where(number[scanning] < last, best[scanning] * float(self.k), math.inf) * (1 + MARGIN) + 1
            by_mean = np.where(gap < far, gap, 0).astype(np.float64) ** 2
            open_ = (gap < far) & (by_mean <= bar)
            scanning, at, down, by_mean, bar = scanning[open_], at[open_], down[open_], by_mean[open_], bar[open_]
            left[scanning] -= down
            right[scanning] += ~down
            near = by_mean + (deviations[scanning] - self.deviations[at]) ** 2 <= bar
            rows, at = scanning[near], at[near]
            apart = x[rows] - self.sorted[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            self.measured += len(rows)
            named = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (named < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], named[better]
        return number, best


def _blocks(batch: pa.RecordBatch, components: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS):
        part = batch.column("packed").slice(start, ROWS)
        joined = b"".join(part.to_pylist())
        yield start, np.frombuffer(joined, dtype="<i4").reshape(-1, components).astype(np.int64)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """Per centroid: number of its vectors, sum of their distances, sum of each component."""
    clusters, components = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        sums = np.zeros((clusters, components), np.int64)
        counts = np.zeros(clusters, np.int64)
        inertia = [0] * clusters
        for batch in batches:
            for _, x in _blocks(batch, components):
                number, distance = search.nearest(x)
                for c in range(clusters):
                    mine = number == c
                    counts[c] += int(mine.sum())
                    sums[c] += x[mine].sum(axis=0)
                    # Up to 2 ** 62 each, so halves are added apart.
                    d = distance[mine]
                    inertia[c] += (int((d >> 32).sum()) << 32) + int((d & 0xFFFFFFFF).sum())
        cells = [
            (c, j, total)
            for c in range(clusters)
            if counts[c]
            for j, total in [(COUNT, int(counts[c])), (INERTIA, inertia[c]), *enumerate(sums[c].tolist())]
        ]
        named = zip(*cells, strict=True) if cells else ((), (), ())
        types = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        arrays = [pa.array(list(col), t) for col, t in zip(named, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "component", "total"])

    parts = vectors.select("packed").mapInArrow(run, "cluster int, component int, total decimal(38,0)")
    totals = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"))
    counts, inertias = [0] * clusters, [0] * clusters
    sums = [[0] * components for _ in range(clusters)]
    for row in totals.collect():
        total = int(row["total"])
        if row["component"] == COUNT:
            counts[row["cluster"]] = total
        elif row["component"] == INERTIA:
            inertias[row["cluster"]] = total
        else:
            sums[row["cluster"]][row["component"]] = total
    return counts, inertias, sums


def fit(
    vectors: DataFrame, key: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> Clustering:
    """Centroids after the rounds, and what a last assignment to them gives.

    ``vectors`` comes from ``integer_vectors`` and is read once per round, so it should be stored.
    """
    centroids = first_centroids(vectors, key, clusters, seed)
    if not len(centroids):
        return Clustering(centroids, [], [])
    for _ in range(rounds):
        counts, _, sums = cluster_sums(vectors, centroids)
        moved = [
            [total // n for total in row] if n else old for n, row, old in zip(counts, sums, centroids.tolist(), strict=True)
        ]
        # Equal centroids give equal sums again, so the remaining rounds would change nothing.
        if moved == centroids.tolist():
            break
        centroids = np.array(moved, dtype=np.int64)
    counts, inertias, _ = cluster_sums(vectors, centroids)
    return Clustering(centroids, counts, inertias)


def assign(vectors: DataFrame, key: str, clustering: Clustering) -> DataFrame:
    """(key, cluster, distance) of every kept vector."""
    centroids = clustering.centroids
    schema = T.StructType(
        [vectors.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids) if len(centroids) else None
        for batch in batches:
            for start, x in _blocks(batch, centroids.shape[1] if search else 1):
                if search is None:
                    raise ValueError("there are vectors, but no centroids")
                number, distance = search.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(x)), pa.array(number, pa.int32()), pa.array(distance)],
                    names=[key, "cluster", "distance"],
                )

    return vectors.select(key, "packed").mapInArrow(run, schema)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame,
    key: str,
    vector: str,
    components: int = COMPONENTS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """Key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    An inertia beyond 64 bits is null. The table of clusters has ``clusters`` rows and is broadcast.
    """
    vectors = checkpointed(integer_vectors(df, key, vector, components, scale), "vectors")
    found = fit(vectors, key, clusters, rounds, seed)
    most = (1 << 63) - 1
    whole = sum(found.inertias)
    rows = [
        (c, own if own <= most else None, whole if whole <= most else None, centroid_digest(found.centroids[c]))
        for c, own in enumerate(found.inertias)
    ]
    number = fresh_name(df, "__cluster")
    facts = df.sparkSession.createDataFrame(
        rows, f"{number} int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    assigned = assign(vectors, key, found)
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col(number)).drop(number)
