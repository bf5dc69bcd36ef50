"""Nothing disappears without a sign: misses, gaps, repetitions, null keys, odd names, late rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import benchmarks, prefix, timeline
from corpusloom.operators.embedding import CACHE_SCHEMA, attach_embeddings, cache_misses
from corpusloom.operators.responses import assemble_responses
from corpusloom.sources import readers, tables
from corpusloom.streaming.debounce import latest_in_window_stream
from corpusloom.streaming.responses import assemble_responses_stream, stream_to_html
from corpusloom.streaming.run import run_available, with_end
from tests.test_streaming import EVENTS, TOKENS, parts

START = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def test_a_text_without_embedding_fails(spark):
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    cache = cache_misses(texts.where("text = 'a'"), spark.createDataFrame([], CACHE_SCHEMA), "m")
    with pytest.raises(Exception, match="no embedding for text"):
        attach_embeddings(texts, cache, "m").collect()
    known = attach_embeddings(texts.where("text = 'a' or text is null"), cache, "m").collect()
    assert {r.text: r.embedding is None for r in known} == {"a": False, None: True}


def test_responses_with_gaps_and_repetitions(spark):
    rows = [
        ("gap", 0, "a", False), ("gap", 2, "c", True),
        ("twice", 0, "x", False), ("twice", 0, "x", False), ("twice", 1, "y", False), ("twice", 2, None, True),
        ("open", 0, "o", False), (None, 0, "n", True),
    ]
    df = spark.createDataFrame(rows, TOKENS)
    for segment in (1, 2, 100):
        got = {r.response_id: (r.response, r.tokens) for r in assemble_responses(df, segment).collect()}
        assert got == {"twice": ("xy", 2), None: ("n", 1)}


def test_stream_counts_as_the_batch_and_hands_out_what_is_behind_a_gap(spark, tmp_path):
    schema = TOKENS + ", ts timestamp"
    batches = [
        [("gap", 0, "a", False, at(0)), ("gap", 3, "d", False, at(0)), ("twice", 1, "y", False, at(0))],
        [("twice", 1, "y", False, at(1)), ("twice", 0, "x", False, at(1)), ("gap", 2, "c", False, at(1))],
        [("twice", 0, "x", False, at(2)), ("twice", 2, None, True, at(2)), ("gap", 0, "a", False, at(2))],
        [("late", 0, "z", True, at(1000))],
    ]
    made = assemble_responses_stream(parts(spark, tmp_path / "in", batches, schema), 60_000, "1 second")
    got = {r.response_id: tuple(r)[1:] for r in run_available(made, "g1").collect()}
    assert got == {"twice": ("xy", 2, True, 0), "gap": ("acd", 3, False, 1), "late": ("z", 1, True, 0)}
    shown = stream_to_html(parts(spark, tmp_path / "in2", batches, schema), 60_000, "1 second")
    rows = [r for r in run_available(shown, "g2").collect() if r.response_id == "gap"]
    assert "".join(r.html for r in sorted(rows, key=lambda r: r.seq)) == "acd"
    assert [r.missing for r in sorted(rows, key=lambda r: r.seq)][-1] == 1


def test_null_keys_are_a_key(spark):
    rows = [(i, k, at(i)) for i, k in enumerate([1, None, None, 1, None])]
    events = spark.createDataFrame(rows, EVENTS)
    got = timeline.latest_in_window(events, window="1 second", bucket_seconds=2).collect()
    same = timeline.latest_in_window(events.fillna(7, ["user_id"]), window="1 second", bucket_seconds=2).collect()
    assert {r.event_id for r in got} == {r.event_id for r in same} and any(r.user_id is None for r in got)
    asked = events.withColumn("resp_ts", F.col("ts") + F.expr("interval 1 second"))
    assert {r.event_id for r in timeline.drop_stale_results(asked, events, bucket_seconds=2).collect()} == {0, 3, 4, 2}
    numbers = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r.g: r.median for r in benchmarks.exact_median(numbers, ["g"], "v").collect()} == {None: 2.0, "a": 5.0}
    keyed = spark.createDataFrame([(k, i * 5000, 1) for i in range(3) for k in (None, "a")], "g string, k long, n long")
    totals = prefix.running_total(keyed, "k", "n", "t", ("g",)).collect()
    assert sorted((r.g or "", r.k, r.t) for r in totals) == sorted((g, i * 5000, i) for i in range(3) for g in ("", "a"))


def test_names_with_underscores_and_dots_are_read(spark, tmp_path):
    for name in ("_a.txt", ".b.txt", "c.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    assert sorted(r.content for r in readers.read_text_document(spark, str(tmp_path)).collect()) == [".b.txt", "_a.txt", "c.txt"]
    assert [r.content for r in readers.read_text_document(spark, str(tmp_path / "_a.txt")).collect()] == ["_a.txt"]


def test_only_a_missing_table_counts_as_none(spark, tmp_path):
    assert not tables.table_exists(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert not tables.table_exists(spark, str(tmp_path / "empty"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):  # noqa: B017
        tables.table_exists(spark, str(tmp_path / "broken"))


def test_late_rows_have_an_output(spark, tmp_path):
    batches = [[(0, 1, at(0))], [(1, 1, at(100))], [(2, 1, at(1))], [(3, 1, at(200))]]
    stream = latest_in_window_stream(parts(spark, tmp_path / "in", batches, EVENTS), 500, "1 second")
    got = {(r.event_id, r.late, r.fire is None) for r in run_available(stream, "late").collect()}
    assert got == {(0, False, False), (1, False, False), (2, True, True)}


def test_the_end_of_a_stream_decides_what_waits(spark, tmp_path):
    batches = [[(0, 1, at(0)), (1, 2, at(0))], [(2, 1, at(5))]]
    events, end = with_end(parts(spark, tmp_path / "in", batches, EVENTS), "e", ts=datetime(2200, 1, 1), event_id=-1, user_id=-1)
    got = {r.event_id for r in run_available(latest_in_window_stream(events, 1000, "60 seconds"), "l", end).collect()}
    assert got == {0, 1, 2}
