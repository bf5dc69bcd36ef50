"""Splits, permutation, packing, perplexity windows, medians: properties and brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.rng import uniform, uniform_value
from corpusloom.operators import benchmarks, perplexity, prefix
from corpusloom.operators import training as op


def docs(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows = [(i * 7 - 300, [f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, tokens array<string>")


def test_draws_are_the_same_everywhere(spark):
    df = spark.range(5).select("id", uniform("x", F.col("id"), F.lit("k"), seed=3))
    assert all(r[1] == uniform_value("x", r[0], "k", seed=3) for r in df.collect())


@pytest.mark.parametrize("bits", [2, 12])
def test_running_total_over_any_key_range(spark, monkeypatch, bits):
    monkeypatch.setattr(prefix, "RADIX_BITS", bits)
    rng = random.Random(bits)
    rows = [(g, k, rng.randrange(5)) for g in ("a", "b") for k in rng.sample(range(-50_000, 50_000), 120)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = {(r.g, r.k): r.before for r in prefix.running_total(df, "k", "n", "before", ("g",)).collect()}
    assert got == {(g, k): sum(n for h, j, n in rows if h == g and j < k) for g, k, _ in rows}


def test_packing_keeps_order_and_drops_only_the_tail(spark):
    rows, df = docs(spark)
    flat = [t for _, tokens in sorted(rows) for t in [*tokens, "<eos>"]]
    for size in (1, 7, 64):
        got = {r.piece: r for r in op.pack_constant_length(df, "id", "tokens", size).collect()}
        assert sorted(got) == list(range(len(flat) // size))
        assert all(got[p].input_ids == flat[p * size : (p + 1) * size] == got[p].labels for p in got)
        shard = df.withColumn("s", F.lit(0))
        bounded = op.pack_constant_length(shard, "id", "tokens", size, by=("s",), bounded=True)
        assert {r.piece: r.input_ids for r in bounded.collect()} == {p: r.input_ids for p, r in got.items()}


def test_one_row_longer_than_many_pieces(spark):
    df = spark.createDataFrame([(1, list("abc") * 1000), (2, [])], "id long, tokens array<string>")
    got = op.pack_constant_length(df, "id", "tokens", 10)
    assert got.count() == 300 and set(got.select(F.size("input_ids")).distinct().collect()) == {(10,)}


def test_split_is_disjoint_complete_and_exact(spark):
    df = spark.range(1000)
    rate = df.where(op.is_validation(F.col("id"), 0.2)).count() / 1000
    assert 0.15 < rate < 0.25
    for fraction in (0.005, 0.1, 0.333, 1.0):
        flags = op.train_val_split_exact(df, "id", fraction)
        assert flags.count() == 1000
        chosen = {r.id for r in flags.where("is_validation").collect()}
        ranked = sorted(range(1000), key=lambda i: (uniform_value("v", i), i))
        assert chosen == set(ranked[: math.ceil(round(fraction * 1000, 9))])


def test_take_and_skip(spark):
    df = spark.range(10, 20)
    first, rest = op.take_skip(df, "id", 3)
    assert {r.id for r in first.collect()} == {10, 11, 12}
    assert {r.id for r in rest.collect()} == set(range(13, 20))


def test_shuffle_is_a_permutation_that_changes_with_epoch(spark):
    df = spark.range(500)
    orders = [
        [r.id for r in op.shuffle_rank(df, "id", epoch=e).orderBy("rank").collect()] for e in (0, 0, 1)
    ]
    assert orders[0] == orders[1] != orders[2]
    assert all(sorted(o) == list(range(500)) for o in orders)
    assert [r.id for r in op.shuffle_rows(df, "id", partitions=4).collect()] == orders[0]


@pytest.mark.parametrize("truncate", [False, True])
def test_permutation_keeps_all_tokens(spark, truncate):
    rows, df = docs(spark)
    got = df.select("id", op.fim_permute(F.col("tokens"), F.col("id"), truncate=truncate).alias("f"))
    before = dict(rows)
    modes = Counter()
    for r in got.select("id", "f.*").collect():
        old, new = before[r.id], r.tokens
        modes[r.mode] += 1
        if r.mode == "none":
            assert new == old
            continue
        marks = {"<fim-prefix>", "<fim-suffix>", "<fim-middle>"}
        plain = [t for t in new if t not in marks]
        assert marks <= set(new) and new[0] == "<fim-prefix>"
        assert (new[1] == "<fim-suffix>") == (r.mode == "spm") or new[1] == "<fim-suffix>"
        if truncate:
            assert len(new) == len(old) and not Counter(plain) - Counter(old)
        else:
            assert Counter(plain) == Counter(old) and len(new) == len(old) + 3
        pre, rest = (new.index(m) for m in ("<fim-suffix>", "<fim-middle>"))
        if r.mode == "psm" and not truncate:
            prefix_, suffix, middle = new[1:pre], new[pre + 1 : rest], new[rest + 1 :]
            assert prefix_ + middle + suffix == old
        if r.mode == "spm" and not truncate:
            assert new[rest + 1 :] + new[2:rest] == old
    assert set(modes) == {"none", "psm", "spm"}


def test_markers_are_required(spark):
    with pytest.raises(ValueError):
        op.fim_permute(F.col("t"), F.col("id"), markers=None)


def windows_by_sets(n, length, stride):
    """{position: window}: a position counts in the first window that covers it, among its last ``stride``
    positions and behind its first one."""
    begins = [b for b in range(0, n, stride) if b == 0 or b - stride + length < n]
    spans = [set(range(b, min(b + length, n))) for b in begins]
    return {
        t: w
        for w, span in enumerate(spans)
        for t in span.difference(*spans[:w])
        if min(span) < t and max(span) - stride < t
    }


def test_windows_equal_their_sets(spark):
    cases = [(n, length, stride) for n in (1, 2, 7, 16, 33, 64) for length in (4, 8, 16) for stride in (1, 3, 4, 8) if stride <= length]
    for n, length, stride in cases:
        t = spark.range(n).select("id", perplexity.ppl_window(F.col("id"), F.lit(n), length, stride).alias("w"))
        assert {r.id: r.w for r in t.collect() if r.w is not None} == windows_by_sets(n, length, stride)


def test_perplexity_weighs_windows_equally(spark):
    rows = [("m", 0, 1.0, 100), ("m", 1, 3.0, 1), ("n", 0, 1.0, 5)]
    df = spark.createDataFrame(rows, "model string, window long, mean_nll double, scored long")
    got = [(r.model, round(r.ppl, 6)) for r in perplexity.perplexity(df).collect()]
    assert got == [("n", round(math.e, 6)), ("m", round(math.e**2, 6))]


def test_exact_median_with_ties_and_one_large_group(spark):
    rng = np.random.default_rng(0)
    groups = {"big": rng.integers(0, 50, 4001), "real": rng.normal(size=2000), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("big", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in benchmarks.exact_median(df, ["g"], "v").collect()}
    assert got == {g: pytest.approx(np.median(v)) for g, v in groups.items()}


def test_missing_samples_are_nan_and_the_first_cpu_sample_is_ignored(spark):
    rows = [("m", 1, 1, "cpu", 90.0), ("m", 2, 2, "cpu", 10.0), ("m", 3, 3, "cpu", 30.0), ("m", 1, 4, "ram_mb", 2000.0)]
    df = spark.createDataFrame(rows, "model_name string, ts int, sample_id int, metric string, value double")
    row = benchmarks.resource_summary(df).first()
    assert (row.cpu_usage, row.ram_gb) == (20.0, 2.0) and math.isnan(row.gpu_usage) and math.isnan(row.vram_gb)
    assert benchmarks.resource_summary(df, "max").first().cpu_usage == 30.0


def test_ranks_are_permuted_alike_everywhere(spark):
    from corpusloom.functions.rng import permuted_rank, permuted_rank_value

    orders = {}
    for n in (1, 2, 3, 5, 16, 17, 99, 1000):
        for epoch in (0, 1):
            df = spark.range(n).select("id", permuted_rank(F.col("id"), n, "e", F.lit(epoch), seed=4).alias("at"))
            got = {r["id"]: r["at"] for r in df.collect()}
            assert sorted(got.values()) == list(range(n))
            assert got == {i: permuted_rank_value(i, n, "e", epoch, seed=4) for i in range(n)}
            orders[n, epoch] = got
    assert all(orders[n, 0] != orders[n, 1] for n in (16, 17, 99, 1000))
    far = np.mean([abs(orders[1000, 0][i] - i) for i in range(1000)])
    assert 250 < far < 420


def test_epochs_have_orders_and_draws_of_their_own(spark):
    from corpusloom.plans.training_data import TrainingConfig, measured_ratio, prepare_epochs

    rows = [(i, " ".join(f"t{i}x{j}" for j in range(i % 40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    config = TrainingConfig(seq_length=16, fim_rate=0.5, fim_spm_rate=0.5, validation_fraction=0.1, sequences_per_buffer=8)
    assert 4 < measured_ratio(docs, "id", "text", config, r"\S+") < 9
    got = prepare_epochs(docs, "id", "text", 3, config, r"\S+").collect()
    for epoch in range(3):
        train = sorted((r for r in got if r["epoch"] == epoch and not r["is_validation"]), key=lambda r: r["position"])
        assert [r["position"] for r in train] == list(range(len(train))) and len(train) > 300
        assert [(r["shard"], r["piece"]) for r in train] != sorted((r["shard"], r["piece"]) for r in train)
    held = [r for r in got if r["is_validation"]]
    assert {r["epoch"] for r in held} == {0} and sorted(r["position"] for r in held) == list(range(len(held)))
    by_epoch = [{tuple(r["input_ids"]) for r in got if r["epoch"] == e and not r["is_validation"]} for e in range(3)]
    assert len(by_epoch[0] & by_epoch[1]) < 0.2 * len(by_epoch[0])
    assert all(r["labels"] == r["input_ids"] and len(r["input_ids"]) == 16 for r in got)
    assert prepare_epochs(docs.limit(0), "id", "text", 2, config, r"\S+").collect() == []


def test_whole_pieces(spark):
    rows = spark.createDataFrame([(1, list("abcdefg")), (2, ["x"]), (3, []), (4, list("stu"))], "g int, t array<string>")
    got = {(r["g"], r["piece"], "".join(r["input_ids"])) for r in op.whole_pieces(rows, "t", 3, ("g",)).collect()}
    assert got == {(1, 0, "abc"), (1, 1, "def"), (4, 0, "stu")}
