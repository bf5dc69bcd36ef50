"""Words and small helpers shared by the operators of this folder."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space separate words.
SPACE = r"[\x20\x09-\x0D]+"
#: Runs of ASCII characters that are neither digits nor letters separate words.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column, separators: str = SPACE) -> Column:
    """The words of a text between the separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
