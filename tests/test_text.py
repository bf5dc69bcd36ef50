"""Text functions, prompts, models and reports on small inputs."""

from __future__ import annotations

import html as stdlib_html

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import editor, html, models, prompts, text
from corpusloom.functions.common import explode_once
from corpusloom.operators import completions as comp

RUBY = 'class Greeter\n  def bye\n    puts <todo>\n  end\nend\n'


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values) or "x string")
    return df.select(expression).first()[0]


def test_placeholder_splits_at_the_first(spark):
    parts = one(spark, text.split_placeholder(F.col("c")), c="a<todo>b<todo>c")
    assert tuple(parts) == ("a", "b<todo>c")
    assert one(spark, text.split_placeholder(F.col("c")), c="none") is None
    joined = one(spark, text.join_placeholder(F.col("p"), F.col("s")), p="a", s="b<todo>c")
    assert joined == "a<todo>b<todo>c"
    with pytest.raises(Exception, match="placeholder"):
        one(spark, text.split_placeholder(F.col("c"), strict=True), c="none")


@pytest.mark.parametrize(
    "answer, suffix, lang, expected",
    [
        ("'bye'\n  end\nrest", "\n  end\nend\n", "ruby", "'bye'"),
        ("'bye'\n  end", "\n  end\nend\n", "ruby", "'bye'\n  end"),  # no line feed behind it
        ("  end\nrest", "\n  end\nend\n", "ruby", ""),  # nothing before the first line
        ("'bye'\n end\n  end\nx", "\n  end  \n", "ruby", "'bye'\n end"),
        ("'bye'\n  end\nrest", "\n  end\nend\n", "python", "'bye'\n  end\nrest"),
        ("'bye'\n  end\nrest", "\n  else\nend\n", "ruby", "'bye'\n  end\nrest"),
        ("x", "one line", "ruby", "x"),
        ("a<fim-middle>b", "s", "rust", "a<fim-middle>b"),
    ],
)
def test_completion_of_a_response(spark, answer, suffix, lang, expected):
    found = text.extract_completion(F.col("r"), F.col("s"), F.col("l"))
    assert one(spark, found, r=f"prefix<fim-middle>{answer}", s=suffix, l=lang) == expected
    assert one(spark, found, r="no marker", s=suffix, l=lang) == ""


def test_file_names(spark):
    for name, lang in {"a/b.py": "python", "x.rb": "ruby", "y.tar.gz": "gz", ".bashrc": "", "Makefile": "", "z.": ""}.items():
        assert one(spark, text.lang_from_filename(F.col("n")), n=name) == lang
    assert one(spark, text.model_id_to_fn(F.col("n")), n="org/m/x") == "org--m--x"


def plain_cutoff(value, limit):
    words = value.split(" ")
    if len(words) < limit:
        return value
    head = words[: limit + 1]
    ends = [i for i, w in enumerate(head) if w.endswith(".")]
    skipped = len(head) - 1 - (ends[-1] if ends else 0)
    return " ".join(words[: limit - skipped + 1])


def test_cutoff(spark):
    for value in ["a b. c d e f", "a b c d", "a. b c d.", "", " . . . . .", "x y z w v", "a b c d. e"]:
        assert one(spark, text.cutoff_at_sentence(F.col("t"), 4), t=value) == plain_cutoff(value, 4), value


def test_escape_and_response_html(spark):
    raw = "<a href=\"x\">'&'</a> <todo>"
    assert one(spark, html.html_escape(F.col("t")), t=raw) == stdlib_html.escape(raw)
    got = one(spark, html.format_response_html(F.col("t")), t="a\n\nb\n```python\nx\n\ny```c```python```\n```js\n```")
    assert got == (
        '<div style="font-family: monospace"><p>a</p><p>b<br/><pre>\nx\n\ny</pre>c<pre></pre><br/>```js<br/>```</p></div>'
    )


def test_prompts(spark):
    assert set(prompts.CODE_FUNCTION_TEMPLATES) >= set(prompts.HTML_FUNCTIONS)
    got = one(spark, prompts.code_fn_prompt(F.lit(prompts.CODE_FUNCTION_TEMPLATES["explain"]), F.col("c")), c="f(){code}")
    assert got == "Please describe what this piece of code does:\n\nf(){code}"
    assert one(spark, prompts.chunk_size_for(F.col("m")), m="HUGGINGFACE_GPT2") == 512
    assert one(spark, prompts.chunk_size_for(F.col("m"), strict=False), m="other") is None
    with pytest.raises(Exception, match="no chunk size"):
        one(spark, prompts.chunk_size_for(F.col("m")), m="HUGGINGFACE_STARCHAT")
    assert one(spark, prompts.chat_wrap(F.col("p"), F.lit("chat")), p="q") == "<|system|><|end|><|user|>q<|end|><|assistant|>"


def test_editor_context_at_the_edges(spark):
    doc = "ab\ncd\nef"
    for offset in range(len(doc) + 1):
        r = one(spark, editor.editor_context(F.col("d"), F.lit(offset), 3), d=doc)
        head = doc[:offset]
        assert r.before == doc[max(0, offset - 3) : offset] and r.after == doc[offset : offset + 3]
        assert (r.line, r.character) == (head.count("\n"), len(head) - head.rfind("\n") - 1)
        assert r.region_includes_beginning == (offset <= 3) and r.region_includes_end == (offset + 3 >= len(doc))


def test_models_complete_tasks(spark):
    tasks = spark.createDataFrame([("t1", "ruby", *RUBY.split("<todo>")), ("t2", "python", "a", "b")], "task_name string, lang_id string, prefix string, suffix string")
    loads = {
        "org/echo": lambda: lambda p: p + "X\n  end\nmore",
        "org/mute": lambda: lambda p: pd.Series(["nothing"] * len(p), index=p.index),
    }
    grid = comp.task_model_grid(tasks, list(loads)).drop("prompt")
    got = {(r.task_name, r.model_id): r.full_code for r in models.complete_tasks(grid, loads).collect()}
    assert got == {
        ("t1", "org/echo"): RUBY.replace("<todo>", "X"), ("t1", "org/mute"): RUBY.replace("<todo>", ""),
        ("t2", "org/echo"): "aX\n  end\nmoreb", ("t2", "org/mute"): "ab",
    }
    single = models.apply_model(tasks, "prefix", lambda: lambda p: p.str.upper())
    assert {r.response for r in single.collect()} == {RUBY.split("<todo>")[0].upper(), "A"}


def test_token_scores(spark):
    df = spark.createDataFrame([(["a", "bb"],), ([],)], "t array<string>")
    got = models.score_tokens(df, "t", lambda: lambda tokens: [float(len(t)) for t in tokens])
    assert [r.nll for r in got.collect()] == [[1.0, 2.0], []]


def test_plugged_in_embedder_and_tokenizer(spark):
    df = spark.createDataFrame([("ab c",)], "t string")
    embed = models.model_embedder(lambda: lambda texts: [[len(t), 1] for t in texts])
    split = models.model_tokenizer(lambda: str.split)
    ids = models.model_tokenizer(lambda: lambda t: [ord(c) for c in t], ids=True)
    row = df.select(embed(F.col("t")).alias("v"), split(F.col("t")).alias("w"), ids(F.col("t")).alias("i")).first()
    assert (row.v, row.w, row.i) == ([4.0, 1.0], ["ab", "c"], [97, 98, 32, 99])


def test_grid_and_nested_responses(spark):
    rows = [("t", m) for m in ("c", "a", "b")]
    grid = comp.report_grid(spark.createDataFrame(rows, "task_name string, model_id string"))
    assert {(r.model_id, r.row, r.col) for r in grid.collect()} == {("a", 0, 0), ("b", 0, 1), ("c", 1, 0)}
    answers = spark.createDataFrame([("f", "s", "m1", "x"), ("f", "s", "m2", "y")], "fn string, snippet_name string, model_id string, response string")
    assert tuple(comp.nest_responses(answers, ["m1", "m2"]).first()) == ("f", "s", "x", "y")


def test_results_shown_to_the_user(spark):
    rows = [("r", 0, "foo", ""), ("r", 1, "fob", ")"), ("r", 2, "bar", None), ("r", 3, "fox", ")")]
    df = spark.createDataFrame(rows, "request_id string, index int, text string, suffix string").withColumn("typed_prefix", F.lit("fo"))
    assert {r["index"] for r in comp.valid_completions(df).collect()} == {1, 3}
    assert {r["index"] for r in comp.limit_completions(df, 3).collect()} == {0, 1}


def test_explode_computes_its_array_once(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string").withColumn("l", F.filter(F.split("t", " "), lambda x: x != ""))
    rows = explode_once(df, F.col("l"), "t")
    assert [tuple(r) for r in rows.collect()] == [("a b", 0, "a"), ("a b", 1, "b")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_models_read_tasks_without_a_shuffle(spark):
    """Texts of a grid pass no shuffle on their way to the models; a row of an unknown model fails, one of none stays."""
    rows = [("t", m, "p", "s", "python") for m in ("a", "b", None)]
    columns = "task_name string, model_id string, prefix string, suffix string, lang_id string"
    grid = spark.createDataFrame(rows, columns)
    loads = {m: lambda m=m: lambda prompts: prompts + m for m in ("a", "b", "c")}
    done = models.complete_tasks(grid, loads)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert {(r.model_id, r.full_code) for r in done.collect()} == {("a", "pas"), ("b", "pbs"), (None, "ps")}
    with pytest.raises(Exception, match="KeyError"):
        models.complete_tasks(grid.fillna({"model_id": "x"}), loads).collect()
