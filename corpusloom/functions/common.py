"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Higher-order functions re-evaluate captured expressions for every array element; a lambda
    variable holds the finished value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lit_or_col(value: Column | str) -> Column:
    """Plain strings are literals, columns stay columns."""
    return value if isinstance(value, Column) else F.lit(value)


def left_of(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n)


def right_from(text: Column, start: Column) -> Column:
    """Text from the 1-based position ``start`` on."""
    return F.substring(text, start, F.length(text))


def after_first(text: Column, mark: Column | str) -> Column:
    """Text behind the first occurrence of ``mark``; '' when it does not occur."""
    mark = lit_or_col(mark)
    at = F.instr(text, mark)
    return F.when(at > 0, right_from(text, at + F.length(mark))).otherwise(F.lit(""))


def explode_once(df: DataFrame, array: Column, *keep: str, pos: str = "pos", value: str = "col") -> DataFrame:
    """One row per element of ``array`` with its 0-based BIGINT position; null and empty arrays give none.

    The plain explode makes the optimizer add a filter on the size of the array, which repeats the
    expression behind it below the explode. The outer form does not, so costly arrays are computed once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("bigint"))
