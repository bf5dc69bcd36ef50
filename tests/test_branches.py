"""Both branches of a switch give the same rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import completions, training, vocabulary


def test_token_ids_by_dictionary_and_by_join(spark):
    rows = [(1, ["a", "b", None, "a"]), (2, []), (3, None), (4, [None]), (5, ["c"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 7), ("b", 3)], "token string, token_id long")
    want = {1: [7, 3, None, 7], 2: [], 3: None, 4: [None], 5: [None]}
    for most in (10, 0):
        got = vocabulary.token_ids(df, vocab, "k", strict=False, max_broadcast=most).collect()
        assert {r.k: r.token_ids for r in got} == want
        known = vocabulary.token_ids(df.where("k < 5"), vocab, "k", max_broadcast=most).collect()
        assert {r.k: r.token_ids for r in known} == {k: v for k, v in want.items() if k < 5}
        with pytest.raises(Exception, match="token without id: c"):
            vocabulary.token_ids(df, vocab, "k", max_broadcast=most).collect()


def test_take_and_skip_by_a_border(spark):
    df = spark.createDataFrame([(i * 7 % 20,) for i in range(20)], "k int")
    for n in (0, 1, 5, 20, 30):
        first, rest = training.take_skip(df, "k", n)
        assert sorted(r.k for r in first.collect()) == list(range(min(n, 20)))
        assert sorted(r.k for r in rest.collect()) == list(range(min(n, 20), 20))


def test_equal_task_names_of_two_languages(spark):
    rows = [(lang, "t", name, f"{lang} {name}") for lang in ("x", "y") for name in ("task", "m1", "m2")]
    df = spark.createDataFrame(rows, "lang_id string, task_name string, base_name string, content string")
    got = {r.lang_id: (r.task, r.completions) for r in completions.stored_results(df).collect()}
    assert got == {k: (f"{k} task", {"m1": f"{k} m1", "m2": f"{k} m2"}) for k in ("x", "y")}
    grid = completions.report_grid(df.withColumn("model_id", F.col("base_name")))
    assert sorted((r.lang_id, r.row, r.col) for r in grid.collect()) == [
        (k, *place) for k in ("x", "y") for place in ((0, 0), (0, 1), (1, 0))
    ]
