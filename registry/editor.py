"""Editor requests, results and events, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import editor as fn
from corpusloom.functions import html
from corpusloom.functions.rng import uniform
from corpusloom.operators import completions as comp
from corpusloom.operators import responses as resp
from corpusloom.operators import timeline as op
from registry.derived import SQL_FENCED, fenced_table, sql_uniform, table, token_stream

MAX_OFFSET = 300
LIMIT = 3


def editor_context(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "n_chars")
    offset = F.floor(uniform("caret", F.col("doc_id")) * (F.col("n_chars") + 1)).cast("int")
    r = d.withColumn("o", offset).select("doc_id", fn.editor_context(F.col("text"), F.col("o"), MAX_OFFSET).alias("r"))
    return r.select("doc_id", "r.*").withColumns({"before": F.md5("before"), "after": F.md5("after")})


def _results(spark, sf):
    """Words of a turn as results of a request; every third one without a suffix."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    words = c.select("conv_id", "turn", "text", F.posexplode(F.split("text", " ")))
    return words.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.col("pos").cast("bigint").alias("index"),
        F.col("col").alias("text"),
        F.when(F.col("pos") % 7 == 5, F.lit(None)).when(F.col("pos") % 3 == 1, "").otherwise(F.lit(")")).alias("suffix"),
        F.substring("text", 1, 1).alias("typed_prefix"),
    )


def valid_completions(spark, sf):
    return comp.valid_completions(_results(spark, sf)).select("request_id", "index", "text", "suffix")


def limit_completions(spark, sf):
    return comp.limit_completions(_results(spark, sf), LIMIT).select("request_id", "index", "text")


def _events(spark, sf):
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")


def ignore_edit(spark, sf):
    e = _events(spark, sf)
    kept = e.where(op.act_on_edit(F.floor("value") - 5, F.col("event_type") != "error"))
    return kept.select("event_id", "user_id")


def latest_in_window(spark, sf):
    acting = op.latest_in_window(_events(spark, sf), window="1 hour")
    return acting.select("event_id", "user_id", "ts", "fire")


def drop_stale_results(spark, sf):
    e = _events(spark, sf)
    requests = e.where(F.col("event_type") == "click").select(
        "event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 10 minutes")).alias("resp_ts")
    )
    return op.drop_stale_results(requests, e.select("user_id", "ts")).select("event_id", "user_id", "ts")


def assemble_responses(spark, sf):
    done = resp.assemble_responses(token_stream(spark, sf))
    return done.select("response_id", F.md5("response").alias("response_md5"), "tokens")


def stream_to_html(spark, sf):
    fenced = fenced_table(spark, sf).select("doc_id", F.col("fenced").alias("response"))
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), F.col("text").alias("response")
    )
    shown = html.stream_response_html(F.col("response"))
    return fenced.unionByName(turns).select("doc_id", F.md5(shown).alias("html_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        editor_context, valid_completions, limit_completions, ignore_edit, latest_in_window,
        drop_stale_results, assemble_responses, stream_to_html,
    )
}

_RESULTS = """
  words AS (SELECT conv_id || '-' || turn AS request_id, text AS full_text, string_split(text, ' ') AS l FROM conversations),
  results AS (SELECT request_id, full_text, i - 1 AS index, l[i] AS text,
      CASE WHEN (i - 1) % 7 = 5 THEN NULL WHEN (i - 1) % 3 = 1 THEN '' ELSE ')' END AS suffix
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM words))"""

_OPEN = "[\\n \\t]```\\S*"
_CLOSE = "[\\n \\t]```"
_BLOCK = f"{_OPEN}(?:{_CLOSE}|\\s[\\s\\S]*?(?:{_CLOSE}|\\z))"

ORACLE = {
    "editor_context": f"""WITH o AS (SELECT doc_id, text, length(text) AS n,
            CAST(floor({sql_uniform("caret", "doc_id")} * (n_chars + 1)) AS BIGINT) AS o FROM documents),
        b AS (SELECT *, greatest(0, o - {MAX_OFFSET}) AS bg, least(n, o + {MAX_OFFSET}) AS en,
            string_split(substr(text, 1, o), chr(10)) AS lines FROM o)
        SELECT doc_id, md5(substr(text, bg + 1, o - bg)) AS before, md5(substr(text, o + 1, en - o)) AS after,
          o AS offset, CAST(len(lines) - 1 AS BIGINT) AS line, CAST(length(lines[-1]) AS BIGINT) AS character,
          bg = 0 AS region_includes_beginning, en = n AS region_includes_end FROM b""",
    "valid_completions": f"""WITH {_RESULTS}
        SELECT request_id, index, text, suffix FROM results WHERE suffix <> ''""",
    "limit_completions": f"""WITH {_RESULTS}
        SELECT request_id, index, text FROM results
        WHERE index < {LIMIT} AND starts_with(text, substr(full_text, 1, 1))""",
    "ignore_edit": """SELECT event_id, user_id FROM events
        WHERE floor(value) - 5 >= 1 AND event_type <> 'error'""",
    "latest_in_window": """WITH n AS (SELECT event_id, user_id, ts,
            lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        f AS (SELECT *, CASE WHEN prev_ts IS NULL THEN ts + INTERVAL 1 HOUR
            WHEN ts - prev_ts > INTERVAL 1 HOUR THEN ts ELSE prev_ts + INTERVAL 1 HOUR END AS fire FROM n)
        SELECT event_id, user_id, ts, fire FROM f WHERE fire = ts OR next_ts IS NULL OR next_ts > fire""",
    "drop_stale_results": """SELECT event_id, user_id, ts FROM events r WHERE event_type = 'click'
        AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.ts > r.ts
          AND e.ts <= r.ts + INTERVAL 10 MINUTE)""",
    "assemble_responses": """SELECT conv_id || '-' || turn AS response_id, md5(text) AS response_md5,
          CAST(len(regexp_extract_all(text, '\\S+|\\s+')) AS BIGINT) AS tokens
        FROM conversations WHERE role = 'assistant' AND text <> ''""",
    # text outside blocks, line feeds marked up, around the untouched blocks; the tail is raw
    "stream_to_html": f"""WITH {SQL_FENCED},
        r AS (SELECT doc_id, fenced AS t FROM fenced
          UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations),
        p AS (SELECT doc_id, regexp_split_to_array(t, '{_BLOCK}') AS texts, regexp_extract_all(t, '{_BLOCK}') AS blocks FROM r),
        q AS (SELECT doc_id, list_transform(blocks, lambda b: regexp_replace(regexp_replace(b, '^{_OPEN}', chr(10) || '<pre>'),
              '{_CLOSE}$', chr(10) || '</pre>')) AS blocks,
            list_transform(texts, lambda x: replace(x, chr(10), '<br>' || chr(10)))[1:-2] AS heads,
            texts[-1] AS last, regexp_extract(texts[-1], '[\\n \\t](?:`{{0,2}}|```\\S*)$') AS tail FROM p)
        SELECT doc_id, md5(coalesce(list_reduce(list_transform(list_zip(heads, blocks), lambda z: z[1] || z[2]),
            lambda x, y: x || y, ''), '') || replace(left(last, length(last) - length(tail)), chr(10), '<br>' || chr(10)) || tail)
          AS html_md5 FROM q""",
}
