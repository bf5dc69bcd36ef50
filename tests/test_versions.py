"""An index that follows changes equals one that is built afresh."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.tokens import hash_embedding
from corpusloom.session import scratch_path, scratch_root
from corpusloom.sources import versions
from corpusloom.streaming.corpus import index_changes_stream

SCHEMA = "path string, extension string, size long, line_count long, last_modified timestamp_ntz, content string, gone boolean"
T0 = datetime(2024, 5, 1)


def event(path: str, minute: int, content: str | None) -> tuple:
    text = content or ""
    at = T0 + timedelta(minutes=minute)
    return (path, ".txt", len(text), text.count("\n"), at, content, content is None)


def history(seed: int, paths: int = 25) -> list[tuple]:
    """Versions of files with times of their own; some end, some come back."""
    draw = random.Random(seed)
    events = []
    for p in range(paths):
        for minute in sorted(draw.sample(range(100), draw.randrange(1, 5))):
            text = " ".join(f"w{draw.randrange(40)}" for _ in range(draw.randrange(1, 60)))
            events.append(event(f"dir/f{p}.txt", minute, None if draw.random() < 0.3 else text))
    draw.shuffle(events)
    return events


def newest(events: list[tuple]) -> dict:
    last: dict = {}
    for e in events:
        if e[0] not in last or e[4] > last[e[0]][4]:
            last[e[0]] = e
    return {p: e[5] for p, e in last.items() if not e[6]}


def stored(spark, table: str) -> list[tuple]:
    rows = versions.current_chunks(spark, table).select("path", "part", "num_parts", "content", "embedding", "doc_id")
    return sorted(map(tuple, rows.collect()), key=repr)


def afresh(spark, events: list[tuple]) -> list[tuple]:
    table = scratch_path(spark, "fresh")
    last = [e for e in events if not e[6] and newest(events).get(e[0]) == e[5] and e[4] == max(x[4] for x in events if x[0] == e[0])]
    versions.apply_changes(spark.createDataFrame(last, SCHEMA), table, 0, scratch_path(spark, "cache"), size=80, overlap=0)
    return stored(spark, table)


def test_unordered_batches_equal_an_index_built_afresh(spark):
    events = history(1)
    table, cache = scratch_path(spark, "versions"), scratch_path(spark, "cache")
    for batch in range(3):
        part = events[batch::3]
        for _ in range(2 if batch == 1 else 1):  # a batch that runs again counts once
            versions.apply_changes(spark.createDataFrame(part, SCHEMA), table, batch, cache, size=80, overlap=0)
    got = stored(spark, table)
    assert got == afresh(spark, events)
    assert {g[0] for g in got} == set(newest(events))
    vectors = spark.createDataFrame([(g[3],) for g in got], "t string").select("t", hash_embedding(F.col("t")).alias("v"))
    assert {(r["t"], tuple(r["v"])) for r in vectors.collect()} == {(g[3], tuple(g[4])) for g in got}
    assert versions.compact(spark, table) == 1
    assert stored(spark, table) == got
    # A batch that the compaction holds is not taken again; later ones are, also with an older version of a file.
    versions.apply_changes(spark.createDataFrame(events[1::3], SCHEMA), table, 1, cache, size=80, overlap=0)
    assert stored(spark, table) == got
    late = [event("dir/f0.txt", -5, "too late"), event("dir/new.txt", 7, "new text"), event(got[-1][0], 500, None)]
    versions.apply_changes(spark.createDataFrame(late, SCHEMA), table, 3, cache, size=80, overlap=0)
    assert versions.compact(spark, table) == 2
    assert stored(spark, table) == afresh(spark, [*events, *late])


def test_a_batch_that_was_not_committed_is_not_read(spark, monkeypatch):
    table, cache = scratch_path(spark, "versions"), scratch_path(spark, "cache")
    versions.apply_changes(spark.createDataFrame([event("a", 1, "one")], SCHEMA), table, 0, cache)
    write = versions._write_batch

    def broken(df, table, kind, generation, batch):
        if kind == "files":
            raise OSError("lost")
        write(df, table, kind, generation, batch)

    monkeypatch.setattr(versions, "_write_batch", broken)
    change = spark.createDataFrame([event("a", 2, "two"), event("b", 2, "b")], SCHEMA)
    with pytest.raises(OSError, match="lost"):
        versions.apply_changes(change, table, 1, cache)
    assert [g[3] for g in stored(spark, table)] == ["one"]
    monkeypatch.setattr(versions, "_write_batch", write)
    versions.apply_changes(change, table, 1, cache)
    assert [g[3] for g in stored(spark, table)] == ["two", "b"]


def test_vanished_files_and_files_that_cannot_be_split(spark):
    table, cache = scratch_path(spark, "versions"), scratch_path(spark, "cache")
    code = ("x.py", ".py", 5, 1, T0, "x = 1", False)
    versions.apply_changes(spark.createDataFrame([event("a", 1, "one"), event("b", 1, "b"), code], SCHEMA), table, 0, cache)
    scanned = spark.createDataFrame([event("a", 1, "one")], SCHEMA).drop("gone")
    tombstones = versions.vanished(scanned, table, "2024-06-01 00:00:00")
    versions.apply_changes(tombstones, table, 1, cache)
    assert {g[0] for g in stored(spark, table)} == {"a"}
    bad = ("a", ".py", 5, 1, T0 + timedelta(days=90), "x = = 1", False)
    errors = versions.apply_changes(spark.createDataFrame([bad], SCHEMA), table, 2, cache)
    assert [r["path"] for r in errors.collect()] == ["a"] and stored(spark, table) == []
    with pytest.raises(Exception, match="without path"):
        versions.apply_changes(spark.createDataFrame([event("a", 1, "x")[:0] + (None, *event("a", 1, "x")[1:])], SCHEMA), table, 3, cache)


def test_empty_batches_and_an_empty_table(spark):
    table, cache = scratch_path(spark, "versions"), scratch_path(spark, "cache")
    assert versions.compact(spark, table) == 0
    with pytest.raises(ValueError, match="nothing is stored"):
        versions.current_chunks(spark, table)
    versions.apply_changes(spark.createDataFrame([], SCHEMA), table, 0, cache)
    assert stored(spark, table) == [] and versions.current_files(spark, table).collect() == []


def test_streamed_changes(spark):
    events = history(3)
    folder, table = scratch_path(spark, "changes"), scratch_path(spark, "versions")
    for i in range(3):
        spark.createDataFrame(events[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    index_changes_stream(changes, table, scratch_path(spark, "cache"), scratch_path(spark, "state"), size=80, overlap=0).awaitTermination()
    assert versions.versions(spark, table).agg(F.max("batch")).first()[0] == 2
    assert stored(spark, table) == afresh(spark, events)


def test_a_batch_leaves_no_copies_of_contents(spark):
    """What a batch stores on its way is deleted; its errors can be read all the same, also of a batch that is held."""
    root = Path(scratch_root(spark).removeprefix("file:"))
    copies = lambda: {p.name for kind in ("changed-*", "chunks-*") for p in root.glob(kind)}
    before, table, cache = copies(), scratch_path(spark, "versions"), scratch_path(spark, "cache")
    rows = [event("a.txt", 1, "old"), event("a.txt", 2, "new"), event("b.txt", 1, "b"), ("c.py", ".py", 5, 0, T0, "def (", False)]
    for batch in (0, 0, 1):
        errors = versions.apply_changes(spark.createDataFrame(rows, SCHEMA), table, batch, cache)
        assert copies() == before and [r.path for r in errors.collect()] == ["c.py"]
    versions.compact(spark, table)
    assert versions.apply_changes(spark.createDataFrame(rows, SCHEMA), table, 1, cache).collect() == []
    assert copies() == before and sorted(r[3] for r in stored(spark, table)) == ["b", "new"]
