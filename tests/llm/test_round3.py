"""Runs of words, centroid clusters and shards against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import centroids, periodic, sharding
from corpusloom.llm.queries import QUERIES, planted_repeats
from corpusloom.llm.sql import ORACLE
from corpusloom.operators import prefix
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period over the whole text, one comparison after the other."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def repetitive(draw: random.Random, most: int = 250) -> list[str]:
    n = draw.choice([0, 1, 23, 24, 25, 26, 60, 120, most])
    words = [str(draw.randrange(draw.choice([1, 2, 3, 60]))) for _ in range(n)]
    for _ in range(draw.randrange(4) if n else 0):
        a = draw.randrange(n)
        p = draw.randrange(1, 1 + max(1, (n - a) // 3))
        for i in range(a, draw.randrange(a, n) + 1):
            words[i] = words[a + (i - a) % p]
    return words


def as_tuples(runs: np.ndarray) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in runs.tolist()]


def test_runs_against_all_periods():
    draw = random.Random(7)
    texts = [repetitive(draw) for _ in range(1500)]
    found = periodic.runs_of(texts)
    assert [as_tuples(f) for f in found] == [sorted(plain_runs(t), key=lambda r: (r[0], r[2])) for t in texts]
    assert sum(len(f) for f in found) > 150


def test_runs_with_a_third_of_the_text_as_period():
    for period in (1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100):
        for extra in (0, 1, 5):
            unit = list(range(period))
            words = ["x", *(unit * 30)[: max(24, 3 * period + extra)], "y"]
            assert as_tuples(periodic.runs_of([words])[0]) == [(1, max(24, 3 * period + extra), period)]
            short = ["x", *(unit * 30)[: max(24, 3 * period) - 1], "y"]
            assert as_tuples(periodic.runs_of([short])[0]) == []


def test_appending_word_by_word_or_at_once_is_the_same():
    draw = random.Random(8)
    for _ in range(15):
        words = np.array([int(w) for w in repetitive(draw, 150)], np.int64)
        whole = periodic.Stream(len(words))
        whole.append(words)
        single, pieces = periodic.Stream(len(words)), periodic.Stream(len(words))
        for i in range(len(words)):
            single.append(words[i : i + 1])
        at = 0
        while at < len(words):
            step = draw.randrange(1, 40)
            pieces.append(words[at : at + step])
            at += step
        assert as_tuples(whole.runs()) == as_tuples(single.runs()) == as_tuples(pieces.runs())


def test_equal_fingerprints_of_other_words_are_noticed(monkeypatch):
    real, tried = periodic.Stream._scattered, []

    def poor(self, words):
        tried.append(self.base)
        return real(self, words) if len(tried) > 2 else (words >= 0).astype(np.uint64)

    monkeypatch.setattr(periodic.Stream, "_scattered", poor)
    words = [str(i) for i in range(40)] + ["a"] * 24
    assert as_tuples(periodic.runs_of([words])[0]) == [(40, 24, 1)] and len(tried) == 3


def test_long_repetitive_texts_take_few_steps():
    same = periodic.runs_of([["a"] * 200_000])[0]
    assert as_tuples(same) == [(0, 200_000, 1)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    words = list(fib[-1][:3000])
    assert as_tuples(periodic.runs_of([words])[0]) == sorted(plain_runs(words), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    start, length, period = best or (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
    milli = 1000 * length // period if best else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), start, length, period, milli, sha(lines), sha(kept)


def test_periodic_query_against_all_periods(spark):
    short = "SELECT doc_id, text FROM documents WHERE length(text) < 9000"
    texts = connect(SF_DIR).execute(short).fetchall()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == connect(SF_DIR).execute("SELECT count(*) FROM documents").fetchone()[0]
    assert len(texts) > 150
    assert [got[i] for i, _ in texts] == [plain_row(i, t) for i, t in texts]
    assert any(r[1] for r in got.values())


def test_runs_of_odd_rows(spark):
    long = " ".join(["word"] * 50_000)
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, long, 5), (4, long, 6), (None, "a " * 30, 7), (6, "ä  b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    found = periodic.with_runs(df)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=repr)
    want = [
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 50_000, 1)], "word"), (4, [(0, 50_000, 1)], "word"),
        (6, [], "ä b"), (None, [(0, 30, 1)], "a"),
    ]
    assert got == sorted(want, key=repr)
    assert periodic.with_runs(df.limit(0)).collect() == []
    drawn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    bare = spark.createDataFrame([(i, t) for i in drawn for t in (None, "", " ", "one")], "doc_id long, text string")
    kept = sorted(map(repr, planted_repeats(bare).collect()))
    assert kept == sorted(map(repr, bare.collect()))
    planted = planted_repeats(df.select("doc_id", "text")).collect()
    assert {r["text"] for r in planted if r["doc_id"] is None} == {"a " * 30}


def plain_clusters(vectors: dict[int, list[int]], clusters: int, rounds: int) -> tuple[dict, list]:
    first = sorted(vectors, key=lambda i: sha(f"3:{i}"))[:clusters]
    middles = [vectors[i] for i in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        members = {}
        for x in vectors.values():
            members.setdefault(nearest(x)[1], []).append(x)
        for c, xs in members.items():
            middles[c] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    return {i: nearest(x) for i, x in vectors.items()}, middles


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_clusters_against_every_distance(spark, spread):
    draw = random.Random(spread)
    vectors = {i: [draw.randrange(-spread, spread + 1) for _ in range(4)] for i in range(300)}
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in vectors.items()], "id long, v array<double>")
    got = centroids.cluster_vectors(df.repartition(4), "id", "v", components=4, clusters=6, rounds=4, scale=1)
    want, middles = plain_clusters(vectors, 6, 4)
    rows = got.collect()
    assert {r["id"]: (r["distance"], r["cluster"]) for r in rows} == want
    for r in rows:
        assert r["centroid_sha256"] == sha(",".join(map(str, middles[r["cluster"]])))
        assert r["cluster_inertia"] == sum(d for d, c in want.values() if c == r["cluster"])
        assert r["inertia"] == sum(d for d, _ in want.values())


def test_search_leaves_out_most_centroids_and_decides_ties_by_number():
    draw = np.random.default_rng(3)
    middles = draw.integers(-9, 9, (40, 3)) * np.array([[1000], [1]] * 20)
    middles[7] = middles[3]
    search = centroids.Search(middles)
    x = np.concatenate([draw.integers(-9000, 9000, (500, 3)), middles, draw.integers(-3, 3, (200, 3))])
    number, distance = search.nearest(x)
    every = ((x[:, None, :] - middles[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
    assert search.measured < 0.7 * every.size


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.0, 0.0], 1), (2, [0.0, nan], 1), (3, [inf, 0.0], 1), (4, [None, 0.0], 1), (5, [1.0], 1), (6, None, 1),
        (None, [5.0, 5.0], 1), (1, [0.0, 0.0], 2), (7, [], 1), (8, [-0.5, 0.25], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, cluster int")
    got = centroids.cluster_vectors(df, "vec_id", "v", components=2, clusters=8, scale=2)
    kept = [(r["vec_id"], r["distance"]) for r in got.collect()]
    assert sorted(kept, key=repr) == sorted([(1, 0), (1, 0), (None, 0), (8, 0)], key=repr)
    assert centroids.cluster_vectors(df.limit(0), "vec_id", "v", components=2).collect() == []
    assert centroids.cluster_vectors(df, "vec_id", "v", components=9).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, v array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(huge, "vec_id", "v", components=2).collect()


def shards_of(rows: list[tuple], shards: int) -> dict:
    """Rows (key, text) to (size, shard, slot) in order of key, checksum and size."""
    sized = sorted(
        ((k is not None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8), k) for k, t in rows
    )
    total, before, slots, out = sum(s[0][3] for s in sized), 0, {}, []
    for (_, _, crc, size), k in sized:
        shard = (2 * before + size) * shards // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((k, size, crc, shard, slots[shard]))
        before += size
    return out


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_IN_RANGE", 20)
    draw = random.Random(2)
    rows = [(draw.choice([None, 5, *range(100)]), draw.choice([None, "", "ä", "x" * draw.randrange(90)])) for _ in range(700)]
    rows += [(5, "the same text")] * 400 + [(9, "z" * 3000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, row int").repartition(6)
    got = sharding.balanced_shards(df, shards=10)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(shards_of(rows, 10), key=repr)
    assert sharding.balanced_shards(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="rename"):
        sharding.balanced_shards(df.withColumnRenamed("doc_id", "Size"), key=["Size"])


def test_shards_are_even_and_contiguous(spark):
    rows = QUERIES["op13_shards"](spark, "/root/testdata/sf0.01").collect()
    sizes, spans = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        spans.setdefault(r["shard"], []).append(r["doc_id"])
    assert sorted(sizes) == list(range(24))
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    ends = [(min(s), max(s)) for _, s in sorted(spans.items())]
    assert all(a[1] < b[0] for a, b in pairwise(ends))


def test_shards_as_files(spark, tmp_path):
    rows = [(i // 3, "x" * (i % 50)) for i in range(300)] + [(None, "null"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bounds = sharding.shard_bounds(sharding.balanced_shards(docs, shards=6))
    sharding.write_shards(docs, bounds, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, stored.select("doc_id", "text").collect())) == sorted(map(repr, docs.collect()))
    spans = stored.groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert len(spans) == 6 and all(p["b"] < n["a"] for p, n in pairwise(spans))


@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_shards"])
def test_result_does_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        result = QUERIES[name](spark, SF_DIR).toArrow()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert differences(result, connect(SF_DIR).execute(ORACLE[name]).to_arrow_table()) is None
