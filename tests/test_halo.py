"""Windows with context and plugged-in scorers against a plain loop; sequences in the order of text keys."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import halo, perplexity, prefix, training
from corpusloom.plans.evaluation import scorer_perplexity
from registry.evaluation import cache_scorer


def plain_windows(sequence: list, max_length: int, stride: int) -> list[tuple[int, list, int]]:
    """The loop over window starts: (window, tokens, first scored)."""
    found, reached = [], 0
    for k, begin in enumerate(range(0, len(sequence), stride)):
        end = min(begin + max_length, len(sequence))
        new = min(stride, end - reached)
        found.append((k, sequence[begin:end], max(end - begin - new, 1)))
        reached = end
        if end == len(sequence):
            break
    return found


def corpus(draw: random.Random, n: int) -> list[tuple[str | None, list[str]]]:
    sizes = [0, 1, 3, 10, 200]
    rows = [(f"dir{draw.randrange(9)}/f{i}", [f"w{draw.randrange(20)}" for _ in range(draw.choice(sizes))]) for i in range(n)]
    return [*rows, (None, ["null"])] if n > 3 else rows


def joined(rows: list[tuple], gap: list[str]) -> list[str]:
    out: list[str] = []
    for i, (_, tokens) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))):
        out += (gap if i else []) + tokens
    return out


@pytest.mark.parametrize(("n", "length", "stride"), [(40, 32, 8), (40, 30, 7), (40, 8, 8), (1, 16, 4), (2, 5000, 10)])
def test_windows_against_a_loop(spark, n, length, stride):
    rows = corpus(random.Random(n + length), n)
    df = spark.createDataFrame(rows, "path string, tokens array<string>").repartition(3)
    sequence = perplexity.joined_in_order(df, ["path"], "tokens", ["|", "|"])
    flat = joined(rows, ["|", "|"])
    windows = halo.halo_windows(sequence, "tokens", F.lit(len(flat)), length, stride).collect()
    got = sorted((r["window"], r["tokens"], r["first_scored"]) for r in windows)
    assert got == plain_windows(flat, length, stride)


def test_scored_like_the_loop_scores(spark):
    rows = corpus(random.Random(5), 30)
    df = spark.createDataFrame(rows, "path string, tokens array<string>").repartition(4)
    models = {
        "a": halo.ScoredModel(lambda: cache_scorer(10), 32, batch=3),
        "b": halo.ScoredModel(lambda: cache_scorer(50), 32),
        "c": halo.ScoredModel(lambda: cache_scorer(10), 64),
    }
    flat = joined(rows, ["|"])
    means, want = {}, {}
    for name, unseen, length in (("a", 10, 32), ("b", 50, 32), ("c", 10, 64)):
        for k, tokens, first in plain_windows(flat, length, 16):
            nll = cache_scorer(unseen)([tokens])[0][first:]
            if nll:
                means[name, k] = (sum(nll) / len(nll), len(nll))
        want[name] = math.exp(sum(m for (n, _), (m, _) in means.items() if n == name) / sum(n == name for n, _ in means))
    for deal in (True, False):
        scored = scorer_perplexity(df, ["path"], "tokens", models, ["|"], 16, deal)
        got = {(r["model"], r["window"]): (r["mean_nll"], r["scored"]) for r in scored.collect()}
        assert got.keys() == means.keys()
        assert all(got[k][0] == pytest.approx(means[k][0]) and got[k][1] == means[k][1] for k in means)
        ranked = perplexity.perplexity(scored).collect()
        assert [r["model"] for r in ranked] == sorted(want, key=want.get)
        assert all(r["ppl"] == pytest.approx(want[r["model"]]) for r in ranked)


def test_segments_are_handed_over_whole_and_scored_as_lists_or_blocks(spark):
    """A scorer of lists and one of blocks give the same; null tokens and a length that segments were not made for."""
    draw = random.Random(8)
    rows = [(f"f{i}", [draw.choice(["a", "b", None, "c d"]) for _ in range(draw.choice([0, 5, 300]))]) for i in range(20)]
    df = spark.createDataFrame(rows, "path string, tokens array<string>").repartition(3)
    flat = joined(rows, [])
    assert isinstance(cache_scorer(9), halo.BlockScorer) and not isinstance(cache_scorer(9).__call__, halo.BlockScorer)
    kinds = {"list": lambda: cache_scorer(9).__call__, "block": lambda: cache_scorer(9)}
    models = {f"{kind} {n}": halo.ScoredModel(make, n, batch=3) for kind, make in kinds.items() for n in (16, 40, 10_000)}
    scored = scorer_perplexity(df, ["path"], "tokens", models, [], 16)
    assert "MapInArrow" in (plan := scored._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
    got = {(r["model"], r["window"]): (r["mean_nll"], r["scored"]) for r in scored.collect()}
    want = {}
    for name, model in models.items():
        for k, tokens, first in plain_windows(flat, model.max_length, 16):
            if nll := cache_scorer(9)([tokens])[0][first:]:
                want[name, k] = (pytest.approx(sum(nll) / len(nll)), len(nll))
    assert got == want


def test_nothing_to_score(spark):
    model = {"a": halo.ScoredModel(lambda: cache_scorer(10), 32)}
    for rows in ([], [("a", [])], [("a", ["one"])], [("a", None)]):
        df = spark.createDataFrame(rows, "path string, tokens array<string>")
        assert scorer_perplexity(df, ["path"], "tokens", model, [], 16).collect() == []


def test_packing_in_order_of_a_hot_range(spark, monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_IN_RANGE", 20)
    draw = random.Random(3)
    rows = [("a/same" if i % 10 else f"b{i}", ["w"] * draw.choice([0, 1, 9])) for i in range(600)] + [(None, ["n"] * 3)]
    df = spark.createDataFrame(rows, "path string, tokens array<string>").repartition(5)
    total = sum(len(t) + 1 for _, t in rows)
    pieces = training.pack_in_order(df, ["path"], "tokens", 16).collect()
    assert sorted(r["piece"] for r in pieces) == list(range(total // 16))
    whole = [t for r in sorted(pieces, key=lambda r: r["piece"]) for t in r["input_ids"]]
    assert whole.count("w") + whole.count("<eos>") + 3 == len(whole) and whole[:4] == ["n", "n", "n", "<eos>"]
    shards = training.shards_in_order(df.select("path", F.size("tokens").alias("n")), ["path"], "n", 100).collect()
    assert len(shards) == len(rows) and {r["shard"] for r in shards} == set(range(max(r["shard"] for r in shards) + 1))


def test_no_window_carries_tokens(spark, monkeypatch):
    """Neither tokens nor text pass a window or the exchange by ranges; only keys and sizes do."""
    seen = []
    keep = prefix.ordered_totals
    monkeypatch.setattr(prefix, "ordered_totals", lambda df, *a, **k: seen.append(df.columns) or keep(df, *a, **k))
    df = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"])], "path string, tokens array<string>")
    packed = training.pack_in_order(df, ["path"], "tokens", 2)
    assert [r["input_ids"] for r in packed.orderBy("piece").collect()] == [["x", "<eos>"], ["y", "z"]]
    assert seen == [["__number", "path", "__n"]]


def test_tokens_pass_the_shuffle_about_once(spark):
    """Windows overlap fourfold and three models read them; the stored segments hardly repeat a token."""
    df = spark.createDataFrame([(f"f{i}", ["w"] * 500) for i in range(40)], "path string, tokens array<string>")
    sequence = perplexity.joined_in_order(df, ["path"], "tokens")
    segments = halo.halo_segments(sequence, "tokens", 64, 16).selectExpr("size(tokens) n", "until").collect()
    assert sum(r["n"] for r in segments) < 1.2 * 20_000 and max(r["until"] for r in segments) == 20_000
    models = {name: halo.ScoredModel(lambda: cache_scorer(10), n) for name, n in (("a", 32), ("b", 64), ("c", 64))}
    scored = scorer_perplexity(df, ["path"], "tokens", models, [], 16)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
