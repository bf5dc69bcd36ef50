"""Streaming forms, run over all available input of a table read as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.functions.common import explode_once
from corpusloom.functions.tokens import STREAM_TOKEN, regex_tokens
from corpusloom.streaming import corpus as corpus_stream
from corpusloom.streaming.debounce import latest_in_window_stream
from corpusloom.streaming.editor import drop_stale_results_stream
from corpusloom.streaming.responses import assemble_responses_stream
from corpusloom.streaming.responses import stream_to_html as html_stream
from corpusloom.streaming.run import run_available, with_end
from corpusloom.session import scratch_path
from registry.derived import sql_uniform

LATENESS_SECONDS = 10
FAR = datetime(2200, 1, 1)
FRACTION = 0.05


def stream(spark, sf, name, *cols):
    """A driver table as a file stream, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # A pattern, as Spark takes a path without one for the folder of partitions, which a file cannot be.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]").select(*cols)


def _tokens(spark, sf):
    turns = stream(spark, sf, "conversations", "conv_id", "turn", "role", "text").where(
        F.col("role") == "assistant"
    )
    lists = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        regex_tokens(F.col("text"), STREAM_TOKEN).alias("l"),
    ).withColumn("n", F.size("l"))
    rows = explode_once(lists, F.col("l"), "response_id", "n", pos="seq", value="token")
    return rows.select(
        "response_id", "seq", "token", (F.col("seq") == F.col("n") - 1).alias("is_end"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp").alias("ts"),
    )


def assemble_responses_streaming(spark, sf):
    done = run_available(assemble_responses_stream(_tokens(spark, sf)), "responses")
    return done.select("response_id", F.md5("response").alias("response_md5"), "tokens", "complete")


def stream_to_html_streaming(spark, sf):
    parts = run_available(html_stream(_tokens(spark, sf)), "html")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("seq", "html"))), lambda p: p["html"])
    whole = parts.groupBy("response_id").agg(F.array_join(pieces, "").alias("html"))
    return whole.select("response_id", F.md5("html").alias("html_md5"))


def stream_to_html_fenced_streaming(spark, sf):
    """Responses with a code block each, whose tokens come in three batches and in no order."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'assistant' and text is not null")
    fenced = F.concat("text", F.lit("\n```python\n"), "text", F.lit("\n```\nEnd of\n"), "text")
    lists = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"), regex_tokens(fenced, STREAM_TOKEN).alias("l")
    ).withColumn("n", F.size("l"))
    rows = explode_once(lists, F.col("l"), "response_id", "n", pos="seq", value="token").select(
        "response_id", "seq", "token", (F.col("seq") == F.col("n") - 1).alias("is_end"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp").alias("ts"),
    )
    folder = scratch_path(spark, "tokens")
    draw = F.xxhash64("response_id", "seq")
    # A batch is a third of the files, so all cores write and read it.
    files = spark.sparkContext.defaultParallelism
    rows.repartition(3 * files, draw).sortWithinPartitions(draw).write.parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    parts = run_available(html_stream(source), "html")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("seq", "html"))), lambda p: p["html"])
    whole = parts.groupBy("response_id").agg(F.array_join(pieces, "").alias("html"))
    return whole.select("response_id", F.md5("html").alias("html_md5"))


def latest_in_window_streaming(spark, sf):
    """When the input ends, what waits in state is decided too."""
    events, end = with_end(stream(spark, sf, "events", "event_id", "user_id", "ts"), "latest", ts=FAR, event_id=-1, user_id=-1)
    acting = latest_in_window_stream(events, 3_600_000, f"{LATENESS_SECONDS} seconds")
    done = run_available(acting, "latest", end)
    return done.where(~F.col("late")).select(
        "event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("fire").cast("timestamp_ntz").alias("fire")
    )


def drop_stale_results_streaming(spark, sf):
    """When the inputs end, waiting requests are decided too."""
    events = stream(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    requests = events.where(F.col("event_type") == "click").withColumn(
        "resp_ts", F.col("ts") + F.expr("interval 10 minutes")
    )
    requests, end_requests = with_end(requests, "requests", ts=FAR, resp_ts=FAR, event_id=-1, user_id=-1)
    edits, end_edits = with_end(stream(spark, sf, "events", "user_id", "ts"), "edits", ts=FAR, user_id=-1)

    def end():
        end_requests()
        end_edits()

    shown = drop_stale_results_stream(requests, edits, "10 minutes", f"{LATENESS_SECONDS} seconds")
    done = run_available(shown, "shown", end)
    return done.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def corpus_streaming(spark, sf):
    """The split of a stream is the split of the table."""
    out = scratch_path(spark, "corpus-rows")
    rows = stream(spark, sf, "documents", "doc_id", "lang", "source")
    corpus_stream.corpus_stream(rows, "doc_id", out, FRACTION, scratch_path(spark, "corpus-state")).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("doc_id", "lang", "source", F.col("is_validation").cast("boolean").alias("is_validation"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        assemble_responses_streaming, stream_to_html_streaming, stream_to_html_fenced_streaming, latest_in_window_streaming,
        drop_stale_results_streaming, corpus_streaming,
    )
}

ORACLE = {
    "assemble_responses_streaming": """SELECT conv_id || '-' || turn AS response_id, md5(text) AS response_md5,
          CAST(len(regexp_extract_all(text, '\\S+|\\s+')) AS BIGINT) AS tokens, true AS complete
        FROM conversations WHERE role = 'assistant' AND text <> ''""",
    # turns have no fences: line feeds are marked up, but for a trailing one
    "stream_to_html_streaming": """SELECT conv_id || '-' || turn AS response_id,
          md5(replace(left(text, length(text) - length(tail)), chr(10), '<br>' || chr(10)) || tail) AS html_md5
        FROM (SELECT *, regexp_extract(text, '[\\n \\t]$') AS tail FROM conversations
              WHERE role = 'assistant' AND text <> '')""",
    # the block is as it came, in marks of its own; line feeds around it are marked up, but for a trailing one
    "stream_to_html_fenced_streaming": """SELECT conv_id || '-' || turn AS response_id,
          md5(replace(text, chr(10), '<br>' || chr(10)) || chr(10) || '<pre>' || chr(10) || text || chr(10) || '</pre><br>'
            || chr(10) || 'End of<br>' || chr(10)
            || replace(left(text, length(text) - length(tail)), chr(10), '<br>' || chr(10)) || tail) AS html_md5
        FROM (SELECT *, regexp_extract(text, '[\\n \\t]$') AS tail FROM conversations WHERE role = 'assistant')""",
    "latest_in_window_streaming": """WITH n AS (SELECT event_id, user_id, ts,
            lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        f AS (SELECT *, CASE WHEN prev_ts IS NULL THEN ts + INTERVAL 1 HOUR
            WHEN ts - prev_ts > INTERVAL 1 HOUR THEN ts ELSE prev_ts + INTERVAL 1 HOUR END AS fire FROM n)
        SELECT event_id, user_id, ts, fire FROM f
        WHERE fire = ts OR next_ts IS NULL OR next_ts > fire""",
    "drop_stale_results_streaming": """SELECT event_id, user_id, ts FROM events r WHERE event_type = 'click'
        AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.ts > r.ts
          AND e.ts <= r.ts + INTERVAL 10 MINUTE)""",
    "corpus_streaming": f"""SELECT doc_id, lang, source, {sql_uniform("v", "doc_id")} < {FRACTION} AS is_validation
        FROM documents""",
}
