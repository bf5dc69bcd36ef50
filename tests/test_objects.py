"""Trees as objects of a store: the same rows as by path, staged writes, nothing left of a failed job."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import filetree, objects


def tree(tmp_path) -> str:
    files = {
        "a.py": "x = 1\n", "b.txt": "", "dir/sub/deep/c.md": "# é\r\nline", "dir/.hidden/d.txt": "d", "_private/e.rb": "e",
        "dir/space in name/f %20.txt": "f", ".staging/job/0": "not yet", "lock/g": "g",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content, newline="")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def rows(df, root: str) -> list[tuple]:
    # Times as floats lose a microsecond, which the two ways may round to different sides.
    time = F.date_trunc("second", F.col("last_modified") + F.expr("interval 5 microseconds"))
    cols = df.withColumn("path", F.substring_index("path", root, -1)).withColumn("last_modified", time)
    return sorted(map(tuple, cols.select("path", "content", "extension", "size", "line_count", "last_modified").collect()))


@pytest.mark.parametrize("driver", [256, 1])
def test_objects_are_scanned_like_paths(spark, tmp_path, monkeypatch, driver):
    monkeypatch.setattr(objects, "MAX_DRIVER_LISTINGS", driver)
    root = tree(tmp_path)
    for options in ({}, {"ignored_dir_regex": None}, {"ignored_file_regex": None}):
        assert rows(filetree.scan_files(spark, f"file://{root}", **options), root) == rows(filetree.scan_files(spark, root, **options), root)
    found = filetree.list_files(spark, f"file://{root}").select("path", "rel_path").collect()
    assert all(r["path"] == f"file://{root}/{r['rel_path']}" for r in found)
    assert {r["rel_path"] for r in found} == {str(p.relative_to(root)) for p in tmp_path.rglob("*") if p.is_file()} - {".staging/job/0"}
    one = filetree.list_files(spark, f"file://{root}/a.py").collect()
    assert [(r["rel_path"], r["path"]) for r in one] == [("a.py", f"file://{root}/a.py")]


def test_files_appear_when_all_tasks_have_written(spark, tmp_path):
    root = tmp_path / "out"
    content = {f"d{i % 7}/f{i}.txt": "é\r\n" * i for i in range(60)}
    df = spark.createDataFrame(list(content.items()), "rel_path string, content string").repartition(6)
    for _ in range(2):  # a second job replaces the files
        filetree.write_files(df, f"file://{root}")
        got = {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file()}
        assert got == content and not (root / ".staging").exists()
    filetree.write_files(df.limit(0), f"file://{root}")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = tmp_path / "out"
    df = spark.range(40).repartition(4).select(
        F.concat(F.lit("f"), "id").alias("rel_path"),
        F.when(F.col("id") == 37, F.raise_error(F.lit("broken")).cast("string")).otherwise("text").alias("content"),
    )
    with pytest.raises(Exception, match="broken"):
        filetree.write_files(df, f"file://{root}")
    assert not root.exists() or [f for _, _, fs in os.walk(root) for f in fs] == []


def test_names_stay_below_the_root(spark, tmp_path):
    df = spark.createDataFrame([("../up.txt", "x")], "rel_path string, content string")
    with pytest.raises(Exception, match="not below the root"):
        filetree.write_files(df, f"file://{tmp_path}/out")
    assert not (tmp_path / "up.txt").exists()
