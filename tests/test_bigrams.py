"""Counts of bigrams where those to be scored are too many for a broadcast."""

from __future__ import annotations

from corpusloom.operators import perplexity as op


def test_other_bigrams_count_together_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_BROADCAST_BIGRAMS", 1)
    monkeypatch.setattr(op, "HASH_BITS", 20)
    rows = [("m", [f"a{i % 3}", f"b{i}", "c", "d"]) for i in range(50)] + [("n", ["c"]), ("n", []), ("n", None)]
    train = spark.createDataFrame(rows, "model string, tokens array<string>")
    only = spark.createDataFrame([("c", "d"), ("a1", "b1"), ("x", "y")], "a string, b string")
    counts = op.fit(train, "model", "tokens", only=only)
    whole = op.fit(train, "model", "tokens")
    found = {(r["model"], r["a"], r["b"]): r["n"] for r in op.pairs_of(counts).collect()}
    assert found[("m", "c", "d")] == 50 and found[("m", "a1", "b1")] == 1
    # 50 bigrams (b, c) and as many (a, b) are not asked for; one or another may share a bit.
    assert len(found) <= 4
    assert sorted(op.firsts_of(counts).collect()) == sorted(op.firsts_of(whole).collect())
