"""Streams in several micro-batches, also out of order, against the batch operators."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.html import stream_response_html
from corpusloom.operators import timeline
from corpusloom.operators.responses import assemble_responses
from corpusloom.streaming import corpus
from corpusloom.streaming.debounce import latest_in_window_stream
from corpusloom.streaming.editor import drop_stale_results_stream
from corpusloom.streaming.responses import assemble_responses_stream, format_step, stream_to_html
from corpusloom.streaming.run import ROCKSDB, rocksdb_state, run_available
from registry import streams

START = datetime(2024, 1, 1)
TOKENS = "response_id string, seq long, token string, is_end boolean"
FENCED = [
    "plain\ntext\n\nend\n",
    "intro\n```python\na = 1\n\nb\n```\nafter",
    "x ```c++ code ``` y\n```\nz",
    "```python\nno start\n```",
    "open\n```py\nnever closed\n",
    "tail\n```tag",
    "a \n``\n`b` ```` c ````",
    "empty\n```py\n```\n\n``` x",
    "\n", " ", "", "\t```\n```\t",
]


def parts(spark, folder: Path, batches, schema, **options):
    """A file stream that delivers one batch per trigger, in the given order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"batch={i}"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(folder / "batch=*"))


def test_fold_does_not_depend_on_token_boundaries(spark):
    rng = random.Random(0)
    pieces = ["\n", " ", "```", "`", "py", "x\n", "\n```", "\n```js\n", "ä", "\t"]
    texts = FENCED + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    whole = [r[1] for r in df.select("i", stream_response_html(F.col("t"))).orderBy("i").collect()]
    for text, expected in zip(texts, whole, strict=True):
        for _ in range(3):
            html, in_code, rest, at = "", False, "", 0
            while at < len(text):
                step = rng.randrange(1, 6)
                new, in_code, rest = format_step(in_code, rest + text[at : at + step], at + step >= len(text))
                html, at = html + new, at + step
            assert html == expected, repr(text)


def test_known_formatting():
    assert format_step(False, "a\n```py\nx\n\ny\n```\nb\n", True)[0] == "a\n<pre>\nx\n\ny\n</pre><br>\nb\n"
    assert format_step(False, "a\n```c++ x", False) == ("a\n<pre> x", True, "")
    assert format_step(False, "a\n``", False) == ("a", False, "\n``")


def token_rows(texts):
    rows = []
    for i, text in enumerate(texts):
        tokens = [text[k : k + 3] for k in range(0, len(text), 3)] or [""]
        rows += [(f"r{i}", k, t, k == len(tokens) - 1) for k, t in enumerate(tokens)]
    return rows


def test_responses_in_shuffled_batches(spark, tmp_path):
    rows = token_rows(FENCED)
    random.Random(1).shuffle(rows)
    batches = [rows[i::3] for i in range(3)]
    got = run_available(assemble_responses_stream(parts(spark, tmp_path / "in", batches, TOKENS), timeout_ms=0), "t1").collect()
    assert {r.response_id: r.response for r in got} == {f"r{i}": t for i, t in enumerate(FENCED)}
    assert len(got) == len(FENCED) and all(r.complete for r in got)

    shown = run_available(stream_to_html(parts(spark, tmp_path / "in2", batches, TOKENS), timeout_ms=0), "t2").collect()
    html = {}
    for r in sorted(shown, key=lambda r: r.seq):
        html[r.response_id] = html.get(r.response_id, "") + r.html
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(FENCED)], "k string, t string")
    assert html == dict(map(tuple, df.select("k", stream_response_html(F.col("t"))).collect()))


def test_responses_share_state_and_travel_in_packs(spark, tmp_path):
    """Calls to the state and rows that reach it grow with groups, not with responses or tokens."""
    texts = {f"r{i}": f"a {i}\n```py\nx\n{i}\n```\nend" for i in range(150)}
    rows = [(r, k, c, k + 1 == len(t)) for r, t in texts.items() for k, c in enumerate(t)]
    random.Random(3).shuffle(rows)
    stream = stream_to_html(parts(spark, tmp_path / "in", [rows[::2], rows[1::2]], TOKENS), timeout_ms=0, groups=2)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        )
        query.awaitTermination()
    assert 0 < max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) < 20
    html = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq):
        html[r.response_id] = html.get(r.response_id, "") + r.html
    assert html == {r: format_step(False, t, True)[0] for r, t in texts.items()}


def test_responses_that_share_state_end_by_themselves(spark, tmp_path):
    """Of one group: a null response, numbers that come twice, a gap, and a time-out while others go on."""
    schema = TOKENS + ", ts timestamp"
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("dead", 0, "half", False, at(0)), ("dead", 3, " z", False, at(0)), ("live", 1, "b", False, at(0)), (None, 0, "n", True, at(0))],
        [("live", 0, "a", False, at(40)), ("live", 0, "A", False, at(40)), ("live", 3, "d", True, at(41)), ("x", 0, "c", True, at(100))],
        [("live", 2, "\n", False, at(95)), ("y", 0, "e", True, at(101))],
    ]
    for groups in (1, 5):
        stream = stream_to_html(parts(spark, tmp_path / f"in{groups}", batches, schema), 60_000, "10 seconds", groups)
        got = {tuple(r) for r in run_available(stream, "shared").collect()}
        assert got == {
            (None, 0, "n", True, 0), ("dead", 0, "half", False, None), ("dead", 3, " z", False, 2),
            ("live", 1, "ab", False, None), ("live", 3, "<br>\nd", True, 0), ("x", 0, "c", True, 0), ("y", 0, "e", True, 0),
        }


def test_batch_assembly_with_segments_and_open_responses(spark):
    rows = [r for r in token_rows(FENCED) if not (r[0] == "r1" and r[3])]
    df = spark.createDataFrame(rows, TOKENS).repartition(7)
    got = {r.response_id: r.response for r in assemble_responses(df, segment=4).collect()}
    assert got == {f"r{i}": t for i, t in enumerate(FENCED) if i != 1}


def test_response_without_end_is_closed_by_time(spark, tmp_path):
    schema = TOKENS + ", ts timestamp"
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("dead", 0, "half", False, at(0)), ("live", 0, "a", False, at(0))],
        [("live", 1, "b", True, at(40)), ("other", 0, "c", True, at(100))],
        [("last", 0, "d", True, at(101))],
    ]
    stream = assemble_responses_stream(parts(spark, tmp_path / "in", batches, schema), 60_000, "1 second")
    got = {(r.response_id, r.response, r.complete) for r in run_available(stream, "t3").collect()}
    assert got == {("dead", "half", False), ("live", "ab", True), ("other", "c", True), ("last", "d", True)}


def events(n=300, users=4, seed=0):
    rng, now, rows = random.Random(seed), 0, []
    for i in range(n):
        now += rng.choice([0, 100, 400, 499, 500, 501, 2000])
        rows.append((i, rng.randrange(users), START + timedelta(milliseconds=now)))
    return rows


EVENTS = "event_id long, user_id long, ts timestamp"


def test_debounce_in_unordered_batches_equals_batch_form(spark, tmp_path):
    rows = events()
    df = spark.createDataFrame(rows, EVENTS)
    # neighbouring batches overlap in time, within the watermark
    keyed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=random.Random(r[0]).random() * 5))
    batches = [keyed[i : i + 60] for i in range(0, len(keyed), 60)]
    for b in batches:
        random.Random(9).shuffle(b)
    got = run_available(
        latest_in_window_stream(parts(spark, tmp_path / "in", batches, EVENTS), 500, "10 seconds"), "t4"
    )
    due = max(r[2] for r in rows) - timedelta(seconds=10)
    batch = timeline.latest_in_window(df, bucket_seconds=7)
    expected = {(r.user_id, r.event_id, r.fire) for r in batch.collect() if r.fire <= due}
    assert {(r.user_id, r.event_id, r.fire) for r in got.collect()} == expected and expected


def test_state_of_waiting_events_is_not_a_row_per_event(spark, tmp_path):
    """Neither do users have state of their own: calls to the state are what a large batch spends its time with."""
    rows = [(i, i % 200, START + timedelta(milliseconds=7 * i)) for i in range(4000)]
    stream = latest_in_window_stream(parts(spark, tmp_path / "in", [rows], EVENTS), 500, "1 hour", groups=4)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        )
        query.awaitTermination()
    assert 0 < max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) < 100


def test_users_that_share_state_do_not_meet(spark, tmp_path):
    """A null user, ids beyond 2**53 and rows that come twice, in groups of any number."""
    users = {0: None, 1: 2**60 + 1, 2: 2**60 + 2, 3: 0, 4: -1}
    rows = [(i, users[u], ts) for i, u, ts in events(300, users=5, seed=6)]
    rows += rows[::9]
    keyed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=random.Random(r[0]).random() * 3))
    last = max(r[2] for r in rows) + timedelta(hours=1)
    batches = [keyed[i : i + 90] for i in range(0, len(keyed), 90)] + [[(900, 7, last)]]
    for groups in (1, 3):
        stream = latest_in_window_stream(
            parts(spark, tmp_path / f"in{groups}", batches, EVENTS), 500, "10 seconds", groups=groups
        )
        got = run_available(stream, "shared").collect()
        assert sorted((r.event_id, r.fire) for r in got) == sorted(brute_rows(rows))
        assert {(r.event_id, r.user_id) for r in got} <= {r[:2] for r in rows} and not any(r.late for r in got)


def brute_rows(rows, window=timedelta(milliseconds=500)):
    """As :func:`brute_latest`, with rows as often as they come."""
    acting = []
    for user in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == user)
        for i, (ts, event_id) in enumerate(mine):
            fire = max(ts, mine[i - 1][0] + window) if i else ts + window
            if fire == ts or i + 1 == len(mine) or mine[i + 1][0] > fire:
                acting.append((event_id, fire))
    return acting


def test_an_event_without_id_fails(spark, tmp_path):
    stream = latest_in_window_stream(parts(spark, tmp_path / "in", [[(None, 1, START), (1, 1, START)]], EVENTS))
    with pytest.raises(Exception, match="no time or no id"):
        run_available(stream, "bad")


def brute_latest(rows, window=timedelta(milliseconds=500)):
    acting = set()
    for user in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == user)
        for i, (ts, event_id) in enumerate(mine):
            before = mine[i - 1][0] if i else None
            fire = ts + window if before is None else max(ts, before + window)
            if fire == ts and before is not None and ts - before == window:
                fire = ts
            later = mine[i + 1][0] if i + 1 < len(mine) else None
            if fire == ts or later is None or later > fire:
                acting.add((event_id, fire))
    return acting


@pytest.mark.parametrize("bucket_seconds", [1, 3600])
def test_debounce_and_stale_results_across_buckets(spark, bucket_seconds):
    rows = events(seed=2, users=2)
    df = spark.createDataFrame(rows, EVENTS)
    got = timeline.latest_in_window(df, bucket_seconds=bucket_seconds).collect()
    assert {(r.event_id, r.fire) for r in got} == brute_latest(rows)
    # the last event of every burst acts
    assert {max((r[2], r[0]) for r in rows if r[1] == u)[1] for u in (0, 1)} <= {r.event_id for r in got}

    wait = timedelta(milliseconds=1500)
    requests = [(i, u, ts, ts + wait) for i, u, ts in rows if i % 3 == 0]
    asked = spark.createDataFrame(requests, EVENTS + ", resp_ts timestamp")
    kept = timeline.drop_stale_results(asked, df, bucket_seconds=bucket_seconds).collect()
    expected = {
        i for i, u, ts, resp in requests if not any(v == u and ts < t <= resp for _, v, t in rows)
    }
    assert {r.event_id for r in kept} == expected and expected


def test_stale_results_on_a_stream(spark, tmp_path):
    rows = events(seed=3)
    wait = timedelta(seconds=2)
    requests = [(i, u, ts, ts + wait) for i, u, ts in rows if i % 2 == 0]
    asked = parts(spark, tmp_path / "q", [requests[:80], requests[80:]], EVENTS + ", resp_ts timestamp")
    edits = parts(spark, tmp_path / "e", [rows[:150], rows[150:]], EVENTS)
    got = {r.event_id for r in run_available(drop_stale_results_stream(asked, edits, "2 seconds", "5 seconds"), "t5").collect()}
    due = min(max(r[2] for r in requests), max(r[2] for r in rows)) - timedelta(seconds=5)
    fresh = {i: ts for i, u, ts, resp in requests if not any(v == u and ts < t <= resp for _, v, t in rows)}
    assert got == {i for i, ts in fresh.items() if ts + wait < due}


def test_a_null_key_is_a_key_of_its_own(spark, tmp_path):
    """In both forms: events and edits of no user meet each other and nobody else's."""
    rows = [(i, None if u == 0 else u, ts) for i, u, ts in events(80, users=2, seed=4)]
    last = max(r[2] for r in rows) + timedelta(hours=1)
    batches = [rows[:40], rows[40:], [(900, 7, last)], [(901, 7, last + timedelta(hours=1))]]
    df = spark.createDataFrame(rows, EVENTS)
    got = run_available(latest_in_window_stream(parts(spark, tmp_path / "e", batches, EVENTS), 500, "1 second"), "n1")
    expected = {(r.user_id, r.event_id) for r in timeline.latest_in_window(df).collect()}
    assert {(r.user_id, r.event_id) for r in got.where("user_id is null or user_id <> 7").collect()} == expected
    assert any(u is None for u, _ in expected)

    wait = timedelta(milliseconds=1500)
    asked = [[(*r, r[2] + wait) for r in b] for b in batches]
    schema = EVENTS + ", resp_ts timestamp"
    stream = drop_stale_results_stream(
        parts(spark, tmp_path / "r", asked, schema), parts(spark, tmp_path / "d", batches, EVENTS), "1 minute", "1 second"
    )
    shown = {(r.user_id, r.event_id) for r in run_available(stream, "n2").where("event_id < 900").collect()}
    requests = spark.createDataFrame([r for b in asked[:2] for r in b], schema)
    kept = {(r.user_id, r.event_id) for r in timeline.drop_stale_results(requests, df).collect()}
    assert shown == kept and any(u is None for u, _ in kept) and len(kept) < len(rows)


def test_index_stream_adds_each_chunk_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = "path string, content string, extension string, size long, line_count long, last_modified timestamp"
    rows = [(f"/s/{i}.txt", f"text {i}", ".txt", 6, 1, START) for i in range(4)]
    stream = parts(spark, tmp_path / "in", [rows[:3], rows[2:]], schema)
    table, cache = str(tmp_path / "table"), str(tmp_path / "cache")
    corpus.index_stream(stream, table, cache, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(table).collect()) == [r[0] for r in rows]
    assert spark.read.parquet(cache).count() == 4


@pytest.mark.parametrize("files", [1, 3])
def test_table_of_one_or_many_files_as_a_stream(spark, tmp_path, files):
    """A driver table is one file, or a folder of that name with files in it."""
    rows = spark.range(9).selectExpr("id as doc_id", "'en' as lang", "'s' as source").repartition(files)
    path = tmp_path / "documents.parquet"
    rows.write.parquet(str(path))
    if files == 1:
        next(path.glob("part-*")).rename(tmp_path / "one")
        path.rename(tmp_path / "rest")
        (tmp_path / "one").rename(path)
    got = streams.corpus_streaming(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(9))


def test_batches_of_fenced_tokens_have_many_files(spark, tmp_path):
    """A batch of one file is written and read by one task, whatever its size."""
    from pathlib import Path

    from corpusloom.session import scratch_root
    from registry import streams

    rows = [(i, 1, "assistant", f"one two three {i}") for i in range(12)]
    columns = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "conversations.parquet"))
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.glob("tokens-*"))
    done = streams.stream_to_html_fenced_streaming(spark, str(tmp_path))
    assert done.count() == 12
    (folder,) = set(root.glob("tokens-*")) - before
    assert len(list(folder.glob("part-*"))) > 3
