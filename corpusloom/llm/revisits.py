"""WARC revisit records resolved by an as-of join.

A revisit says that a page has not changed. It is resolved to the latest full response of the same
canonical URL captured before it; equal times are ordered by record id. The response must agree with the
validators that the revisit names (ETag, compared weakly, else Last-Modified; and the payload digest where
both have one). Then the stored headers are updated with those of the revisit, but for headers that
describe the message or the body, which stay as they were stored.

Outcomes in ``state``: resolved; no_validator (resolved, but nothing to compare); mismatch (a response is
there, but its validators differ); missing (no earlier response). Only revisit rows are returned.

Only keys, times, validators and headers take part; bodies stay where they are and are named by
``refers_to``. The as-of join is a running last value by URL. The rows of URLs with more than ``hot_rows`` rows are
dealt in the order of the join itself (URL, time, record id) to ranges of about that size, each a window
partition of its own, and the last response before each range is carried over from a table with one row per
URL and range. So no task gets all rows of a URL, also when all of them have one time or one id.

Rows with a null URL, time or record id can't be placed: a revisit among them is missing, a response is
ignored. Repeated rows are resolved each; null headers are empty, an empty table gives no rows. Other columns are not
carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.common import let
from corpusloom.llm.common import ascii_lower
from corpusloom.session import checkpointed

#: Headers that a not-modified answer never changes.
STORED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range",
    "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that don't name another page.
TRACKING = "utm_[a-z]*|fbclid|gclid|ref|sessionid"
HOT_ROWS = 50_000
#: Ranges of all hot URLs together, which bounds the rows that one URL has in the table of carried responses.
MOST_RUNS = 2000
#: Hot URLs that are broadcast; more are joined by a shuffle.
MOST_HOT = 100_000


def canonical_url(url: Column) -> Column:
    """One spelling for a page: no scheme, www., default port, fragment, tracking parameters or last slash."""
    rest = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)"))
    joined = F.array_join(F.array_sort(pairs), "&")
    path = F.regexp_replace(path, r"/+$", "")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def header_map(block: Column) -> Column:
    """A header block, one ``name: value`` per line, as a map with names in lower case; the last of a name counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            ascii_lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("key"),
            F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )
    # The pairs are bound, so that they are made once and not for every line.
    last = let(
        pairs,
        lambda ps: F.filter(
            ps, lambda x, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda y: y["key"] == x["key"])
        ),
    )
    return F.map_from_entries(last)


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with those of the not-modified answer in place of their own, where permitted."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*STORED_HEADERS))
    rest = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def header_block(headers: Column) -> Column:
    """A map as lines in the order of the names."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
        ),
        "\n",
    )


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^[Ww]/", "")


def resolve_revisits(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``records``: record_id, url, captured, kind (response, revisit, ...), status, headers (map), digest.

    Full responses are rows of kind response with status 200. Returns one row per revisit: record_id,
    canonical, captured, refers_to, refers_captured, state, headers (merged, or the revisit's own).
    """
    canonical = canonical_url(F.col("url"))
    placed = F.col("url").isNotNull() & F.col("captured").isNotNull() & F.col("record_id").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    rows = records.where(
        (F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200) & placed)
    ).select(
        "record_id", canonical.alias("canonical"), "captured", (F.col("kind") == "revisit").alias("asks"),
        F.coalesce("headers", empty).alias("headers"), "digest", placed.alias("placed"),
    )
    rows = checkpointed(rows, "captures")
    own = rows.where("placed")

    total = own.groupBy("canonical").agg(F.count("*").alias("n"))
    hot = checkpointed(total.where(F.col("n") > hot_rows), "hot-urls")
    found = hot.agg(F.count("*"), F.sum("n")).first()
    if not found[0]:
        return _judged(_with_last(own.withColumn("run", F.lit(0))), rows)
    named = F.broadcast(hot.select("canonical")) if found[0] <= MOST_HOT else hot.select("canonical")
    cold = own.join(named, "canonical", "left_anti").withColumn("run", F.lit(0))
    ranges = min(MOST_RUNS, math.ceil(found[1] / hot_rows))
    dealt = _ranged(own.join(named, "canonical", "left_semi"), ranges)
    answered = _with_last(cold).where("asks").unionByName(_with_carry(_with_last(dealt), dealt))
    return _judged(answered, rows)


def _answer() -> Column:
    """What a response offers to later revisits; null for a revisit."""
    return F.when(~F.col("asks"), F.struct("record_id", "captured", "headers", "digest"))


def _with_last(timed: DataFrame) -> DataFrame:
    order = Window.partitionBy("canonical", "run").orderBy("captured", "record_id", F.col("asks"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return timed.withColumn("last", F.last(_answer(), ignorenulls=True).over(before))


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows with the number of their range in the order of the join; stored, as two plans read the ranges."""
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(ranges, "canonical", "captured", "record_id", "asks", "__row")
    return checkpointed(dealt.withColumn("run", F.spark_partition_id()).drop("__row"), "runs")


def _with_carry(answered: DataFrame, timed: DataFrame) -> DataFrame:
    """Rows without an answer in their run take the last response of the runs before."""
    ends = timed.where(~F.col("asks")).groupBy("canonical", "run").agg(
        F.max_by(F.struct("record_id", "captured", "headers", "digest"), F.struct("captured", "record_id")).alias("end")
    )
    runs = timed.select("canonical", "run").distinct().join(ends, ["canonical", "run"], "left")
    order = Window.partitionBy("canonical").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("canonical", "run", F.last("end", ignorenulls=True).over(order).alias("carried"))
    carried = carried.where("carried is not null")
    joined = answered.where("asks").join(carried, ["canonical", "run"], "left")
    return joined.withColumn("last", F.coalesce("last", "carried")).drop("carried")


def _judged(answered: DataFrame, rows: DataFrame) -> DataFrame:
    stored, asked = F.col("last.headers"), F.col("headers")
    tag, stored_tag = _weak(asked["etag"]), _weak(stored["etag"])
    since = asked["last-modified"]
    same_validator = F.when(tag.isNotNull(), tag.eqNullSafe(stored_tag)).when(
        since.isNotNull(), since.eqNullSafe(stored["last-modified"])
    )
    same_digest = F.when(F.col("digest").isNotNull(), F.col("digest") == F.col("last.digest"))
    state = (
        F.when(F.col("last").isNull(), "missing")
        .when(~F.coalesce(same_validator, F.lit(True)) | ~F.coalesce(same_digest, F.lit(True)), "mismatch")
        .when(same_validator.isNull() & same_digest.isNull(), "no_validator")
        .otherwise("resolved")
    )
    good = state.isin("resolved", "no_validator")
    out = answered.where("asks").select(
        "record_id", "canonical", "captured",
        F.when(good, F.col("last.record_id")).alias("refers_to"),
        F.when(good, F.col("last.captured")).alias("refers_captured"),
        state.alias("state"),
        F.when(good, merged_headers(stored, asked)).otherwise(asked).alias("headers"),
    )
    lost = rows.where("not placed").select(
        "record_id", "canonical", "captured", F.lit(None).cast(rows.schema["record_id"].dataType).alias("refers_to"),
        F.lit(None).cast(rows.schema["captured"].dataType).alias("refers_captured"), F.lit("missing").alias("state"), "headers",
    )
    return out.unionByName(lost)
