"""Workflows over all files."""

from __future__ import annotations

import ast
import hashlib

from corpusloom.plans.indexing import index_source_tree
from corpusloom.session import scratch_path
from registry import workflows
from registry.derived import MODELS, todo_table


def test_the_whole_tree_is_indexed_with_the_splitter_of_each_type(spark, tmp_path):
    code = "\n".join(f"def f{i}(x):\n" + "".join(f"    x += {i * j}\n" for j in range(30)) for i in range(12))
    lines = lambda n: "".join(f"line {i} has some words and goes on\n" for i in range(n))
    files = {"a.py": code, "bad.py": "def (", "b.md": "# Head\n" + lines(300), "c.txt": lines(400), "d": "short", "e.rb": lines(1)}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    stored, cache = scratch_path(spark, "chunks"), scratch_path(spark, "cache")
    for reset in (True, False):
        errors = index_source_tree(spark, str(tmp_path), stored, cache, reset=reset)
    assert [r.path.rsplit("/", 1)[1] for r in errors.collect()] == ["bad.py"]
    got: dict[str, list] = {}
    for r in sorted(spark.read.parquet(stored).collect(), key=lambda r: r.part):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert set(got) == set(files) - {"bad.py"}
    for rows in got.values():
        assert [(r.part, r.num_parts, len(r.embedding)) for r in rows] == [(i, len(rows), 64) for i in range(len(rows))]
    assert min(len(got[n]) for n in ("a.py", "b.md", "c.txt")) > 1 and [r.content for r in got["d"]] == ["short"]
    # every statement of the Python file once, in order; every line of the others in some chunk within the size
    assert ast.unparse(ast.parse("\n".join(r.content for r in got["a.py"]))) == ast.unparse(ast.parse(code))
    for name in ("b.md", "c.txt", "e.rb"):
        assert all(len(r.content) <= 4000 for r in got[name])
        every = {x.strip() for x in files[name].splitlines()}
        assert every <= {x.strip() for r in got[name] for x in r.content.splitlines()}


def test_stored_completions_hold_answers_made_of_whole_prompts(spark, tmp_path):
    """An answer is the whole prompt in capitals, not a number that prompts of one length share."""
    texts = {1: "let größe = 1\n  end\nñandú", 2: "a\nend\nb", 3: "", 4: "é", 5: "x" * 3000 + "y", 10: "x" * 3000 + "z"}
    rows = [(i, t, len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for r in todo_table(spark, str(tmp_path)).collect():
        prefix, suffix = r.code.split("<todo>", 1)
        prompt = f"<fim-prefix>{prefix}<fim-suffix>{suffix}<fim-middle>".replace("ß", "ẞ").upper()
        for model in MODELS:
            full = f"{prefix}{model} {prompt}{suffix}"
            want.add((f"t{r.doc_id}", r.lang_id, model, hashlib.md5(full.encode()).hexdigest()))
    got = workflows.stored_completions_all(spark, str(tmp_path)).collect()
    assert {(r.task_name, r.lang_id, r.model_id, r.full_code_md5) for r in got} == want
    assert len(got) == len(want) == len(texts) * len(MODELS)
