"""Editor requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.common import left_of


def editor_context(document: Column, offset: Column, max_offset: int) -> Column:
    """What a completion request sends for a caret at the 0-based ``offset``.

    The text on both sides is limited to ``max_offset`` characters; the flags say whether it
    reaches the start and the end of the document.
    """
    length = F.length(document)
    begin = F.greatest(F.lit(0), offset - max_offset)
    end = F.least(length, offset + max_offset)
    head = left_of(document, offset)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(
        F.substring(document, begin + 1, offset - begin).alias("before"),
        F.substring(document, offset + 1, end - offset).alias("after"),
        offset.cast("bigint").alias("offset"),
        line.cast("bigint").alias("line"),
        F.length(F.substring_index(head, "\n", -1)).cast("bigint").alias("character"),
        (begin == 0).alias("region_includes_beginning"),
        (end == length).alias("region_includes_end"),
    )
