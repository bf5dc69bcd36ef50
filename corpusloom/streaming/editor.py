"""Stale results, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_stale_results_stream(
    requests: DataFrame,
    edits: DataFrame,
    max_wait: str = "10 minutes",
    lateness: str = "10 seconds",
    key: str = "user_id",
) -> DataFrame:
    """Requests (event_id, user_id, ts, resp_ts) without an edit (user_id, ts) in ``(ts, resp_ts]``.

    An outer join of two streams whose state is bounded by the watermarks: a request is passed on
    once no edit can come any more that would make it stale. ``max_wait`` is the longest time from
    request to response, which limits that state; a longer one fails the job. A null key is a key of its own.
    """
    limit = F.col("ts").cast("timestamp") + F.expr(f"interval {max_wait}")
    in_time = F.when(
        F.col("resp_ts").cast("timestamp") > limit, F.raise_error(F.lit("response after max_wait")).cast("timestamp")
    ).otherwise(F.col("resp_ts").cast("timestamp"))
    asked = requests.select(
        "event_id",
        F.col(key).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        in_time.alias("resp_ts"),
    ).withWatermark("ts", lateness)
    changed = edits.select(
        F.col(key).alias("edit_key"), F.col("ts").cast("timestamp").alias("edit_ts")
    ).withWatermark("edit_ts", lateness)
    between = (
        F.col("key").eqNullSafe(F.col("edit_key"))
        & (F.col("edit_ts") > F.col("ts"))
        & (F.col("edit_ts") <= F.col("resp_ts"))
        & (F.col("edit_ts") <= F.col("ts") + F.expr(f"interval {max_wait}"))
    )
    return asked.join(changed, between, "left_outer").where(F.col("edit_ts").isNull()).select(
        "event_id", F.col("key").alias(key), "ts"
    )
