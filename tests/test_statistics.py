"""Order statistics and plugged-in aggregates against plain versions."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregators, benchmarks, quantiles

HARD = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, -1.0, -1.0 - 2**-52, math.inf, -math.inf]


def disc(values: list, q: float):
    return sorted(values)[max(math.ceil(round(q * len(values), 9)), 1) - 1]


def test_bits_keep_the_order(spark):
    draw = random.Random(1)
    values = HARD + [draw.uniform(-1, 1) * 10 ** draw.randrange(-300, 300) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan]], "v double")
    rows = df.select("v", quantiles.ordered_bits("v").alias("b")).withColumn("back", quantiles.from_ordered_bits("b"))
    got = sorted(rows.collect(), key=lambda r: r["b"])
    assert [r["v"] for r in got[:-1]] == sorted(values) and math.isnan(got[-1]["v"])
    assert all(r["back"] == r["v"] for r in got[:-1])


@pytest.mark.parametrize("kind", ["double", "long"])
@pytest.mark.parametrize("few", [0, 100_000])
def test_quantiles_of_all_groups(spark, monkeypatch, kind, few):
    monkeypatch.setattr(quantiles, "MOST_BROADCAST", few)
    draw = random.Random(2)
    pool = HARD if kind == "double" else [0, 1, -1, 2**62, -(2**62), 2**53 + 1, 2**53, 5]
    more = (lambda: draw.gauss(0, 1)) if kind == "double" else (lambda: draw.randrange(-1000, 1000))
    rows = [(draw.choice("aab") if draw.random() < 0.9 else None, draw.choice(pool) if draw.random() < 0.3 else more()) for _ in range(1500)]
    rows += [("a", None), ("none", None), ("one", pool[2])]
    # One group has nine tenths of the rows.
    rows += [("hot", draw.choice(pool)) for _ in range(6000)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    qs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r["g"], r["quantile"]): r["v"] for r in quantiles.exact_quantiles(df, ["g"], "v", qs).collect()}
    assert len(got) == 6 * 5
    for (g, q), v in got.items():
        own = [x for h, x in rows if h == g and x is not None]
        assert v == (disc(own, q) if own else None)


def test_medians_by_radix_selection(spark, monkeypatch):
    monkeypatch.setattr(benchmarks, "MOST_BRACKETED", 10)
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.choice([None, 1.5, draw.gauss(0, 5)])) for _ in range(999)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["median"] for r in benchmarks.exact_median(df, ["g"], "v").collect()}
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in (1, 2, None)}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_windows_hold_counts_only(spark):
    """As many values as one digit has, all in one group: no window sees the values themselves."""
    df = spark.range(300_000).select(F.lit("g").alias("g"), (F.col("id") / 300_000).alias("v"))
    found = quantiles.exact_quantiles(df, ["g"], "v", [0.5]).collect()
    assert [r["v"] for r in found] == [149_999 / 300_000]


@pytest.mark.parametrize("hot", [False, True])
def test_mean_without_extremes(spark, monkeypatch, hot):
    monkeypatch.setattr(aggregators, "MOST_STATES", 3)
    draw = random.Random(4)
    rows = [("hot" if hot and i % 10 else draw.choice(["a", "b", "c", "d", "e", None]), draw.choice([None, draw.gauss(0, 9)])) for i in range(3000)]
    rows += [("few", float(i)) for i in range(6)] + [("none", None), ("seven", 1.0), *[("seven", 0.0)] * 6]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r["m"] for r in aggregators.aggregate(df, ["g"], "v", aggregators.mean_without_extremes(3), "m").collect()}
    assert got.keys() == {g for g, _ in rows}
    for g, m in got.items():
        own = sorted(v for h, v in rows if h == g and v is not None)
        kept = own[3 : len(own) - 3]
        assert m is None if not kept else m == pytest.approx(statistics.fmean(kept))


def test_any_callable_aggregates(spark):
    """A group is never one array: states of many batches and tasks merge."""
    spread = aggregators.Aggregator(
        lambda: None,
        lambda s, v: s if not len(v) else (min([*v, *([s[0]] if s else [])]), max([*v, *([s[1]] if s else [])])),
        lambda a, b: (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b,
        lambda s: s and s[1] - s[0],
    )
    df = spark.range(100_000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v")).repartition(9)
    got = {r["g"]: r["s"] for r in aggregators.aggregate(df, ["g"], "v", spread, "s").collect()}
    assert got == {g: float((100_000 - 1 - g) // 7 * 7) for g in range(7)}
    assert aggregators.aggregate(df.limit(0), ["g"], "v", spread, "s").collect() == []
