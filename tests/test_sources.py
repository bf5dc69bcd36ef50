"""File trees: what a scan keeps, what it reads, what is written."""

from __future__ import annotations

import time
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import files as fn
from corpusloom.operators import chunking
from corpusloom.operators.completions import stored_results
from corpusloom.plans import indexing
from corpusloom.sources import filetree, readers, tables


def put(root: Path, name: str, content: str | bytes) -> Path:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path


def names(df, root: Path) -> set[str]:
    return {str(Path(r.path).relative_to(root.resolve())) for r in df.select("path").collect()}


@pytest.fixture
def tree(tmp_path):
    put(tmp_path, "one.txt", "first line\nsecond line")
    put(tmp_path, "two.md", "# Heading\ntext\n")
    return tmp_path


def test_empty_directory(spark, tmp_path):
    assert filetree.scan_files(spark, str(tmp_path)).count() == 0


def test_hidden_and_ignored_directories_are_skipped(spark, tree):
    put(tree, ".hidden/inside.txt", "x")
    put(tree, "skipme/inside.txt", "x")
    found = filetree.scan_files(spark, str(tree), ignored_dir_regex="skip.*")
    assert names(found, tree) == {"one.txt", "two.md"}


def test_hidden_directories_can_be_kept_at_every_depth(spark, tree):
    put(tree, ".hidden/inside.txt", "x")
    put(tree, "sub/.deep/inside.txt", "x")
    found = filetree.scan_files(spark, str(tree), skip_hidden_dirs=False)
    assert names(found, tree) == {"one.txt", "two.md", ".hidden/inside.txt", "sub/.deep/inside.txt"}


def test_directory_pattern(spark, tree):
    put(tree, "ignored_dir/inside.txt", "x")
    put(tree, "database/inside.txt", "prefix match of 'data'")
    put(tree, "src/data/inside.txt", "x")
    assert names(filetree.scan_files(spark, str(tree)), tree) == {
        "one.txt", "two.md", "ignored_dir/inside.txt",
    }


def test_file_pattern(spark, tree):
    put(tree, "package-lock.json", "{}")
    assert names(filetree.scan_files(spark, str(tree)), tree) == {"one.txt", "two.md"}
    only = filetree.scan_files(spark, str(tree), ignored_file_regex=r".*\.md")
    assert names(only, tree) == {"one.txt", "package-lock.json"}


def test_modification_time(spark, tree):
    before, after = datetime.now() - timedelta(minutes=1), datetime.now() + timedelta(minutes=1)
    assert filetree.scan_files(spark, str(tree), modified_after=before).count() == 2
    assert filetree.scan_files(spark, str(tree), modified_after=after).count() == 0


def test_attributes(spark, tree):
    put(tree, "mixed", "a\r\nb\rc\n")
    put(tree, ".env", "")
    rows = {Path(r.path).name: r for r in filetree.scan_files(spark, str(tree)).collect()}
    assert (rows["one.txt"].extension, rows["one.txt"].line_count) == (".txt", 2)
    assert (rows["two.md"].extension, rows["two.md"].line_count) == (".md", 2)
    assert rows["one.txt"].size == len("first line\nsecond line")
    assert rows["two.md"].last_modified is not None
    assert (rows["mixed"].content, rows["mixed"].size, rows["mixed"].line_count) == ("a\nb\nc\n", 6, 3)
    assert (rows[".env"].extension, rows[".env"].size, rows[".env"].line_count) == ("", 0, 0)


def test_underscore_files_are_read_and_bad_encodings_left_out(spark, tree):
    put(tree, "pkg/__init__.py", "x = 1\n")
    put(tree, "latin.txt", "Grüße".encode("latin-1"))
    assert names(filetree.scan_files(spark, str(tree)), tree) == {"one.txt", "two.md", "pkg/__init__.py"}


def test_root_name_is_not_tested(spark, tmp_path):
    root = tmp_path / "_data"
    put(root, "kept.txt", "x")
    assert names(filetree.scan_files(spark, str(root)), root) == {"kept.txt"}


def test_deep_tree_is_listed_once(spark, tmp_path):
    for i in range(20):
        for j in range(20):
            put(tmp_path, f"d{i}/e{j}/f.txt", f"{i} {j}")
    found = filetree.scan_files(spark, str(tmp_path))
    assert found.count() == 400
    assert found.select("path").distinct().count() == 400


def test_source_tree_ignores_no_directory(spark, tree):
    put(tree, "data/_private/code.py", "a = 1")
    assert names(readers.read_source_tree(spark, str(tree)), tree) == {"data/_private/code.py"}


def test_text_document(spark, tree):
    rows = readers.read_text_document(spark, str(tree / "one.txt")).collect()
    assert [r.content for r in rows] == ["first line\nsecond line"]


def test_completion_tasks(spark, tmp_path):
    put(tmp_path, "python/add.py", "def add(a, b):\n    <todo>\n# <todo> stays\n")
    put(tmp_path, "python/_odd.py", "no hole")
    tasks, errors = readers.read_completion_tasks(spark, str(tmp_path), "python")
    task = tasks.collect()
    assert [(t.task_name, t.lang_id, t.prefix, t.suffix) for t in task] == [
        ("add.py", "python", "def add(a, b):\n    ", "\n# <todo> stays\n")
    ]
    assert [e.task_name for e in errors.collect()] == ["_odd.py"]
    strict, _ = readers.read_completion_tasks(spark, str(tmp_path), "python", strict=True)
    with pytest.raises(Exception, match="placeholder"):
        strict.collect()


def test_results_written_and_read_back(spark, tmp_path):
    grid = spark.createDataFrame(
        [("python", "add.py", "a", "c", m, "a" + m + "c") for m in ("org/base", "runs/x")],
        "lang_id string, task_name string, prefix string, suffix string, model_id string, full_code string",
    )
    tables.write_results(grid, str(tmp_path / "out"))
    files = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}
    folder = "out/python/add.py/"
    assert files == {folder + "task.py", folder + "org--base.py", folder + "runs--x.py"}
    stored = stored_results(readers.read_stored_completions(spark, str(tmp_path / "out/python"))).collect()
    assert [(r.task_name, r.task, r.completions) for r in stored] == [
        ("add.py", "a<todo>c", {"org/base": "aorg/basec", "runs/x": "aruns/xc"})
    ]


def test_tasks_are_written_with_the_first_model(spark, tmp_path, monkeypatch):
    """Texts of tasks pass no shuffle, but for tasks that the first model has not answered."""
    rows = [("rb", f"t{i}", f"p{i}", "s", m, m) for i in range(4) for m in ("a", "b", "c") if (i, m) not in ((2, "a"), (3, "a"), (3, "b"))]
    schema = "lang_id string, task_name string, prefix string, suffix string, model_id string, full_code string"
    seen = []
    keep = tables.write_files
    monkeypatch.setattr(tables, "write_files", lambda df, out: seen.append(df) or keep(df, out))
    tables.write_results(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    found = {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    want = {f"rb/{t}/{m}": m for _, t, _, _, m, _ in rows} | {f"rb/t{i}/task": f"p{i}<todo>s" for i in range(4)}
    assert found == want
    # texts are read for the tasks that lack it, by their few keys
    assert "LeftSemi" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_report_pages(spark, tmp_path):
    rows = [
        ("ruby", f"t{i}", "x <todo> & y", m, f"{m} <b>") for i in range(3) for m in ("b", "a", "c")
    ]
    grid = spark.createDataFrame(rows, "lang_id string, task_name string, task string, model_id string, full_code string")
    tables.write_html_report(grid, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report/lang_id=ruby").glob("part-*"))
    page = "".join(p.read_text() for p in parts)
    assert page.startswith("<html>") and page.rstrip().endswith("</body></html>")
    assert [page.index(f"<h2>t{i}") for i in range(3)] == sorted(page.index(f"<h2>t{i}") for i in range(3))
    assert '<span class="placeholder">&lt;todo&gt;</span> &amp; y' in page
    assert "c &lt;b&gt;" in page and "<b>" not in page
    assert page.count("<tr>") == 6


def test_report_pages_compressed(spark, tmp_path):
    """Compressed pages are the same lines in less room."""
    body = " ".join(str(i) for i in range(400))
    rows = [("ruby", f"t{i}", f"{i}<todo>\n{body}", m, f"{i}{m}\n{body}") for i in range(60) for m in ("b", "a", "c")]
    grid = spark.createDataFrame(rows, "lang_id string, task_name string, task string, model_id string, full_code string")
    pages = {}
    for kind in ("none", "gzip"):
        tables.write_html_report(grid, str(tmp_path / kind), compression=kind)
        pages[kind] = sorted(r.value for r in spark.read.text(str(tmp_path / kind)).collect())
    assert pages["none"] == pages["gzip"] and len(pages["none"]) > 120
    size = {k: sum(p.stat().st_size for p in (tmp_path / k).rglob("part-*")) for k in pages}
    assert size["gzip"] < size["none"] / 4


def test_snippets_and_questions(spark, tmp_path):
    put(tmp_path, "add.py", "def add(x, y):\n    return x + y\n")
    assert [tuple(r) for r in readers.read_snippets(spark, str(tmp_path)).collect()] == [
        ("add.py", "def add(x, y):\n    return x + y\n")
    ]
    questions = readers.read_questions(spark, ["Why?", "How?"])
    assert [tuple(r) for r in questions.orderBy("query_id").collect()] == [(0, "Why?"), (1, "How?")]


def test_corpus_of_one_language_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([("a", "en"), ("b", "de")], "content string, lang string").write.partitionBy("lang").parquet(path)
    df = readers.read_corpus(spark, path, "de")
    assert [r.content for r in df.collect()] == ["b"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_index_adds_only_what_is_new(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("index")
    table, cache = str(out / "table"), str(out / "cache")
    put(tree, "good.py", "import os\n\n\ndef f():\n    return os.name\n")
    put(tree, "bad.py", "def f(:\n")
    errors = indexing.index_source_tree(spark, str(tree), table, cache)
    assert [Path(r.path).name for r in errors.collect()] == ["bad.py"]
    first = spark.read.parquet(table)
    assert {Path(r.path).name for r in first.select("path").collect()} == {"one.txt", "two.md", "good.py"}
    assert all(r.doc_id.startswith("path='") for r in first.select("doc_id").collect())
    count = first.count()

    put(tree, "three.txt", "third file")
    indexing.index_source_tree(spark, str(tree), table, cache, reset=False)
    again = spark.read.parquet(table)
    assert again.count() == count + 1
    assert again.select("doc_id").distinct().count() == count + 1
    assert spark.read.parquet(cache).select("text_key").distinct().count() == spark.read.parquet(cache).count()

    indexing.index_source_tree(spark, str(tree), table, cache, reset=False)
    assert spark.read.parquet(table).count() == count + 1


def test_load_documents_whole_and_split(spark, tree):
    whole = indexing.load_documents(spark, str(tree)).collect()
    assert {r.metadata["extension"] for r in whole} == {".txt", ".md"}
    parts = indexing.load_documents(
        spark, str(tree), splitter=lambda c: chunking.char_chunks(c, "\n", 12)
    ).collect()
    assert {(Path(r.path).name, r.part, r.num_parts, r.content) for r in parts} >= {
        ("one.txt", 0, 2, "first line"), ("one.txt", 1, 2, "second line"),
    }
    with pytest.raises(ValueError):
        indexing.load_documents(spark, str(tree), splitter=lambda c: c, splitter_factory=lambda c, e: c)


def test_document_id_requires_all_fields(spark):
    df = spark.createDataFrame([("it's", "t", 0, 1, None)], "p string, m string, a int, b int, s int")
    ids = fn.document_id(*[F.col(c) for c in ("p", "m", "a", "b", "s")])
    with pytest.raises(Exception, match="size is missing"):
        df.select(ids).collect()
    full = df.select(fn.document_id(F.col("p"), F.col("m"), F.col("a"), F.col("b"), F.lit(7))).first()[0]
    assert full == "path=\"it's\":last_modified='t':0/1:size=7"


def test_iso_timestamp_and_extensions(spark):
    stamps = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.000600"]
    rows = spark.createDataFrame([(s,) for s in stamps], "s string").select(fn.iso_timestamp(F.col("s").cast("timestamp")))
    assert [r[0] for r in rows.collect()] == [datetime.fromisoformat(s).isoformat() for s in stamps]
    paths = ["a/b.tar.gz", ".bashrc", "x.", "dir.d/plain", "..py", "a.b/.c.d"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(fn.extension(F.col("p")))
    assert [r[0] for r in got.collect()] == [".gz", "", "", "", ".py", ".d"]


def test_quoted_texts_look_like_literals(spark):
    from corpusloom.functions.files import quoted

    chars = [chr(c) for c in [*range(1, 0x180), 0x300, 0x378, 0x200B, 0x2028, 0x2029, 0x202F, 0x3000, 0xE000, 0xFEFF, 0x1F600, 0xE0001, 0x10FFFF]]
    texts = [*chars, "", "it's", 'say "it\'s"', "a\\b\x00\x1b[0m\n", "tab\tend ", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quoted(F.col("t")).alias("q")).collect()
    assert {r["t"]: r["q"] for r in rows} == {t: repr(t) for t in texts}


@pytest.mark.parametrize("uri", [False, True])
def test_very_many_folders_are_few_units_of_work(spark, tmp_path, uri):
    """The driver hands out shares of a folder, not its subfolders one by one; every file is found once."""
    want = set()
    for i in range(2 * filetree.MAX_DRIVER_LISTINGS):
        put(tmp_path, f"lang/task{i}/sub/one", str(i))
        want.add(f"lang/task{i}/sub/one")
    put(tmp_path, "lang/own", "x")
    listed = filetree.list_files(spark, f"file://{tmp_path}" if uri else str(tmp_path))
    got = [r["rel_path"] for r in listed.select("rel_path").collect()]
    assert len(got) == len(want) + 1 and set(got) == want | {"lang/own"}
    assert listed.rdd.getNumPartitions() <= filetree.MAX_DRIVER_LISTINGS + 1


def test_read_batches_are_bounded(tmp_path):
    """Contents held at a time stay below a bound that four tasks of an executor can have."""
    paths = [str(put(tmp_path, f"f{i}", b"x" * 3_000_000)) for i in range(9)]
    batch = pa.RecordBatch.from_pydict({"path": paths})
    parts = list(filetree._read_batches(iter([batch])))
    assert [p["path"].to_pylist() for p in parts] == [paths[:3], paths[3:6], paths[6:]]


def test_report_shuffles_texts_once(spark, tmp_path, monkeypatch):
    """The ranges of the page serve the grouping by task: no second exchange carries the texts."""
    rows = spark.createDataFrame(
        [(f"l{i % 2}", f"t{i}", "a<todo>b", m, f"a{m}b") for i in range(6) for m in ("m1", "m2", "m3")],
        "lang_id string, task_name string, task string, model_id string, full_code string",
    )
    plans = []
    keep = tables.op.report_fragments

    def fragments(df, *args, **kwargs):
        found = keep(df, *args, **kwargs)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(tables.op, "report_fragments", fragments)
    tables.write_html_report(rows, str(tmp_path / "page"))
    grouped = plans[0].split("Union")[0]
    assert grouped.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in grouped
    lines = spark.read.text(str(tmp_path / "page")).collect()
    assert sum("<h2>" in r["value"] for r in lines) == 6 and sum("<html>" in r["value"] for r in lines) == 2


def test_a_stored_table_leaves_nothing_shuffled(spark):
    """Shuffled rows are deleted when the table that they were for is stored, and the setting of the session stays."""
    from corpusloom.session import _CLEANUP, checkpointed

    before, kept = _shuffled(spark), spark.conf.get(_CLEANUP, None)
    rows = spark.range(5000).selectExpr("id", "md5(cast(id as string)) t").repartition(4, "t")
    stored, until = checkpointed(rows), time.time() + 20
    while _shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffled(spark) - before and spark.conf.get(_CLEANUP, None) == kept
    assert stored.count() == 5000


def _shuffled(spark) -> set[str]:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    names = [blocks.apply(i).name() for i in range(blocks.size())]
    return {n for n in names if n.startswith("shuffle")}
