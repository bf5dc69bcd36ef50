"""Running totals over orders of any type."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import prefix


def plain(rows: list[tuple]) -> list[tuple]:
    out, before, seen = [], 0, 0
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        out.append((*row, before, seen))
        before, seen = before + (row[1] or 0), seen + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_ordered_totals_of_text_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix, "LEAST_IN_RANGE", 20)
    draw = random.Random(5)
    keys = [None, "", "a", "ä", "src/x.py", *[f"k{i}" for i in range(300)]]
    rows = [("hot" if draw.random() < hot else draw.choice(keys), draw.choice([None, 0, 3, 7])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5).withColumn("one", F.lit(1).cast("long"))
    placed = prefix.ordered_totals(df, ["k", "n"], {"before": "n", "seen": "one"}, most_in_range=50)
    assert placed.columns == ["k", "n", "one", "before", "seen"]
    got = sorted([(r.k, r.n, r.before, r.seen) for r in placed.collect()], key=repr)
    assert got == plain(rows)


def test_ordered_totals_cut_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_IN_RANGE", 20)
    stored = []
    keep = prefix.checkpointed
    monkeypatch.setattr(prefix, "checkpointed", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    df = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    placed = prefix.ordered_totals(df.withColumn("n", F.lit(1).cast("long")), ["k"], {"at": "n"}, most_in_range=100)
    assert sorted(r["at"] for r in placed.collect()) == list(range(2000))
    largest = max(r["count"] for r in stored[-1].groupBy("__range").count().collect())
    assert largest <= 400


def test_ordered_totals_of_nothing(spark):
    df = spark.createDataFrame([], "k string, n long")
    placed = prefix.ordered_totals(df, ["k"], {"at": "n"})
    assert placed.columns == ["k", "n", "at"] and placed.collect() == []
