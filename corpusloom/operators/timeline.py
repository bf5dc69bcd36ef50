"""Events of one key in time order. Null keys are a key of their own.

A window over all events of a key would put a hot key into one task. Here a window covers one key
and one time bucket; what lies beyond the edges of a bucket comes from a small table with one row
per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import null_safe_join

BUCKET_SECONDS = 3600


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / (seconds * 1_000_000)).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with and without a zone (read as UTC)."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def with_neighbours(
    df: DataFrame, key: str, ts: str, event_id: str, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """Add ``prev_ts`` and ``next_ts`` of the same key, in the order of (ts, event_id)."""
    bucketed = df.withColumn("__b", _bucket(F.col(ts), bucket_seconds))
    inside = Window.partitionBy(key, "__b").orderBy(ts, event_id)
    edges = bucketed.groupBy(key, "__b").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    buckets = Window.partitionBy(key).orderBy("__b")
    beyond = edges.select(
        key,
        "__b",
        F.lag("__last").over(buckets).alias("__before"),
        F.lead("__first").over(buckets).alias("__after"),
    )
    return (
        bucketed.withColumn("prev_ts", F.lag(ts).over(inside))
        .withColumn("next_ts", F.lead(ts).over(inside))
        .transform(null_safe_join, beyond, [key, "__b"])
        .withColumn("prev_ts", F.coalesce("prev_ts", "__before"))
        .withColumn("next_ts", F.coalesce("next_ts", "__after"))
        .drop("__b", "__before", "__after")
    )


def latest_in_window(
    events: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    event_id: str = "event_id",
    window: str = "500 milliseconds",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """The events that act, with the time ``fire`` at which they do.

    An event waits until the window after the event before it has passed, the first one a whole
    window; it acts unless a newer event has come by then. After a longer pause it acts at once.
    """
    span = F.expr(f"interval {window}")
    gap_over = F.col(ts) > F.col("prev_ts") + span
    fire = (
        F.when(F.col("prev_ts").isNull(), F.col(ts) + span)
        .when(gap_over, F.col(ts))
        .otherwise(F.col("prev_ts") + span)
    )
    acts = (
        (F.col("fire") == F.col(ts)) | F.col("next_ts").isNull() | (F.col("next_ts") > F.col("fire"))
    )
    return (
        with_neighbours(events, key, ts, event_id, bucket_seconds)
        .withColumn("fire", fire)
        .where(acts)
        .drop("prev_ts", "next_ts")
    )


def drop_stale_results(
    requests: DataFrame,
    edits: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    resp_ts: str = "resp_ts",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Requests without an edit of the same key in ``(ts, resp_ts]``: their results may be shown."""
    row = F.struct(*requests.columns)
    both = requests.select(key, F.col(ts).alias("__at"), row.alias("__req")).unionByName(
        edits.select(key, F.col(ts).alias("__at"), F.col(ts).alias("__edit")), allowMissingColumns=True
    )
    bucketed = both.withColumn("__b", _bucket(F.col("__at"), bucket_seconds))
    # backwards in time; an edit at the very time of the request does not count
    inside = (
        Window.partitionBy(key, "__b")
        .orderBy(F.desc("__at"), F.asc_nulls_first("__edit"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = bucketed.groupBy(key, "__b").agg(F.min("__edit").alias("__first"))
    later = (
        Window.partitionBy(key).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    )
    beyond = edges.select(
        key, "__b", F.last("__first", ignorenulls=True).over(later).alias("__after")
    )
    next_edit = F.coalesce("__next", "__after")
    return (
        bucketed.withColumn("__next", F.last("__edit", ignorenulls=True).over(inside))
        .where(F.col("__req").isNotNull())
        .transform(null_safe_join, beyond, [key, "__b"])
        .where(next_edit.isNull() | (next_edit > F.col(f"__req.{resp_ts}")))
        .select("__req.*")
    )


def act_on_edit(inserted_length: Column, is_main_editor: Column) -> Column:
    """Edits that may ask for a completion: insertions in the main editor."""
    return (inserted_length >= 1) & is_main_editor
