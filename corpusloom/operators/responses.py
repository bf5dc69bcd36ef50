"""Responses from token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_TOKENS = 4096


def assemble_responses(tokens: DataFrame, segment: int = SEGMENT_TOKENS) -> DataFrame:
    """(response_id, response, tokens) of all responses that are complete.

    ``tokens`` has (response_id, seq, token, is_end). A response is complete when it has every number from 0 to
    that of its end marker. A number that was delivered twice counts once, with the largest token.
    ``tokens`` in the result counts those that are not null: an end marker may have none. Tokens
    are joined to segments of consecutive numbers first, so a long response is spread over tasks until its
    text is put together.
    """

    def joined(pairs: str, value: str, sep: str = "") -> Column:
        return F.array_join(F.transform(F.sort_array(pairs), lambda p: p[value]), sep)

    # sorted by number, then token with nulls first: the last of each number stays
    once = F.filter(
        F.col("delivered"), lambda p, i: ~F.coalesce(F.get("delivered", i + 1)["seq"] == p["seq"], F.lit(False))
    )
    segments = (
        tokens.groupBy("response_id", F.floor(F.col("seq") / segment).alias("segment"))
        .agg(
            F.sort_array(F.collect_set(F.struct("seq", "token"))).alias("delivered"),
            F.min(F.when(F.col("is_end"), F.col("seq"))).alias("end_seq"),
        )
        .withColumn("pairs", once)
        .select(
            "response_id", "segment", F.array_join(F.transform("pairs", lambda p: p["token"]), "").alias("text"),
            "end_seq", F.size("pairs").alias("numbers"),
            F.size(F.filter("pairs", lambda p: p["token"].isNotNull())).alias("n"),
        )
    )
    whole = segments.groupBy("response_id").agg(
        F.collect_list(F.struct("segment", "text")).alias("parts"),
        F.min("end_seq").alias("end_seq"),
        F.sum("numbers").alias("numbers"),
        F.sum("n").alias("tokens"),
    )
    return whole.where(F.col("numbers") == F.col("end_seq") + 1).select(
        "response_id", joined("parts", "text").alias("response"), "tokens"
    )
