"""File trees as a Spark data source.

The built-in file sources leave out names that begin with '_' or '.', which are ordinary source
files here. ``format("filetree")`` lists everything. Listing is split over tasks by directory and
yields names and times only; contents are read later, after the filters, spread by path.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from corpusloom.functions import files as fn
from corpusloom.session import shuffles_dropped
from corpusloom.sources import objects

# Directories that the driver opens at most to find enough units of work for the tasks.
MAX_DRIVER_LISTINGS = 256
BATCH_FILES = 10_000
BATCH_BYTES = 8 * 1024 * 1024

_LISTING = pa.schema(
    [("path", pa.string()), ("rel_path", pa.string()), ("last_modified", pa.timestamp("us", "UTC"))]
)


@dataclass
class Directory(InputPartition):
    """A directory to list: with everything below it, or only its own files.

    Of a directory with very many subdirectories several tasks take a ``share`` each, by a hash of their names; the
    first has its own files too.
    """

    path: str
    deep: bool
    share: int = 0
    shares: int = 1

    def takes(self, name: str) -> bool:
        return self.shares == 1 or zlib.crc32(os.fsencode(name)) % self.shares == self.share


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.single = os.path.isfile(self.root)
        self.skip_hidden = options.get("skiphiddendirs", "false").lower() == "true"
        self.ignored = options.get("ignoreddirregex")

    def _enters(self, name: str) -> bool:
        if self.skip_hidden and name.startswith("."):
            return False
        return not (self.ignored and re.match(self.ignored, name))

    def _subdirs(self, path: str) -> list[str] | None:
        """Folders to enter, without links that lead back to a folder above; None if they are too many to hand out."""
        above, found = os.path.realpath(path), []
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_dir() and self._enters(e.name) and not _leads_back(os.path.realpath(e.path), above):
                    found.append(e.path)
                    if len(found) > MAX_DRIVER_LISTINGS:
                        return None
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        """Top of the tree, level by level, until there are enough directories to hand out."""
        if self.single:
            return [Directory(self.root, deep=False)]
        done, level = [], [self.root]
        while level and len(done) + len(level) < MAX_DRIVER_LISTINGS:
            shares, below = MAX_DRIVER_LISTINGS // len(level), []
            for path in level:
                subdirs = self._subdirs(path)
                if subdirs is None or len(below) + len(subdirs) > MAX_DRIVER_LISTINGS:
                    done += [Directory(path, True, i, shares) for i in range(shares)]
                else:
                    done.append(Directory(path, deep=False))
                    below += subdirs
            level = below
        return done + [Directory(path, deep=True) for path in level]

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        rows = []
        if self.single:
            stamp = _modified(partition.path)
            if stamp:
                yield _batch([(partition.path, os.path.basename(partition.path), stamp)], _LISTING)
            return
        for folder, subdirs, names in os.walk(partition.path, followlinks=True):
            above = os.path.realpath(folder)
            top = folder == partition.path
            subdirs[:] = [
                d for d in subdirs
                if partition.deep and self._enters(d) and (not top or partition.takes(d))
                and not _leads_back(os.path.realpath(os.path.join(folder, d)), above)
            ]
            if top and partition.share:
                continue
            for name in names:
                path = os.path.join(folder, name)
                if not os.path.isfile(path):
                    continue
                stamp = _modified(path)
                if stamp is None:
                    continue
                rows.append((os.path.realpath(path), os.path.relpath(path, self.root), stamp))
                if len(rows) >= BATCH_FILES:
                    yield _batch(rows, _LISTING)
                    rows = []
        if rows:
            yield _batch(rows, _LISTING)


def _leads_back(target: str, above: str) -> bool:
    """Is ``target`` the folder ``above`` or one that contains it? Following it would never end."""
    return above == target or above.startswith(target.rstrip("/") + "/")


def _modified(path: str) -> datetime | None:
    """Time of the last change; None when it can't be read, which leaves the file out."""
    try:
        return datetime.fromtimestamp(os.path.getmtime(path), UTC)
    except (OSError, ValueError, OverflowError):
        return None


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file per row. Each appears under its name in one step, so a retried task does no harm.

        Of a batch one content at a time is a Python object.
        """
        count = 0
        for place, content in ((p, c) for b in iterator for p, c in zip(b["rel_path"], b["content"], strict=True)):
            target = os.path.join(self.root, place.as_py())
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{uuid.uuid4().hex}.part"
            with open(partial, "w", encoding="utf-8", newline="") as out:
                out.write(content.as_py())
            os.replace(partial, target)
            count += 1
        return _Written(count)


class FileTree(DataSource):
    """Read: (path, rel_path, last_modified) of all files. Write: (rel_path, content) as files."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> StructType:
        return StructType(
            [
                StructField("path", StringType()),
                StructField("rel_path", StringType()),
                StructField("last_modified", TimestampType()),
            ]
        )

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _TreeWriter(self.options)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def list_files(
    spark: SparkSession, root: str, skip_hidden_dirs: bool = False, ignored_dir_regex: str | None = None
) -> DataFrame:
    """(path, rel_path, last_modified) of all files below ``root``; skipped directories are not entered.

    A root that is a URI is listed in its own store (``sources.objects``).
    """
    source = objects.ObjectTree if objects.is_uri(root) else FileTree
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("skipHiddenDirs", str(skip_hidden_dirs).lower())
    if ignored_dir_regex is not None:
        reader = reader.option("ignoredDirRegex", ignored_dir_regex)
    return reader.load(root)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``bytes``; a batch is passed on when it has reached its size."""
    for batch in batches:
        start, size, contents = 0, 0, []
        for i, path in enumerate(batch["path"].to_pylist()):
            if objects.is_uri(path):
                contents.append(objects.read_bytes(path))
            else:
                with open(path, "rb") as source:
                    contents.append(source.read())
            size += len(contents[-1])
            if size >= BATCH_BYTES:
                yield batch.slice(start, i + 1 - start).append_column("bytes", pa.array(contents, pa.binary()))
                start, size, contents = i + 1, 0, []
        if contents:
            yield batch.slice(start).append_column("bytes", pa.array(contents, pa.binary()))


def read_contents(manifest: DataFrame) -> DataFrame:
    """Add ``content`` to a manifest; files that are not valid UTF-8 are left out.

    Line ends become line feeds. Files are dealt out by path first, so a directory with very many
    of them is read by all tasks.
    """
    spread = manifest.repartition(F.col("path"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    raw = spread.mapInArrow(_read_batches, f"{columns}, bytes binary")
    text = fn.text_mode(F.col("bytes").cast("string"))
    return raw.where(fn.decodable(F.col("bytes"))).select(
        *manifest.columns, text.alias("content")
    )


def scan_files(
    spark: SparkSession,
    root: str,
    ignored_dir_regex: str | None = fn.IGNORED_DIR_REGEX,
    ignored_file_regex: str | None = fn.IGNORED_FILE_REGEX,
    modified_after: datetime | None = None,
    skip_hidden_dirs: bool = True,
) -> DataFrame:
    """(path, content, extension, size, line_count, last_modified) of the files a scan keeps.

    The name of the root is never tested. Hidden directories are skipped, or kept, at every depth.
    """
    manifest = list_files(spark, root, skip_hidden_dirs, ignored_dir_regex)
    if ignored_file_regex is not None:
        manifest = manifest.where(~fn.is_ignored_file(F.col("rel_path"), ignored_file_regex))
    if modified_after is not None:
        stamp = F.lit(modified_after.timestamp()).cast("timestamp")
        manifest = manifest.where(fn.modified_since(F.col("last_modified"), stamp))
    return file_info(read_contents(manifest))


def file_info(df: DataFrame) -> DataFrame:
    """The columns of a scanned file from (path, content, last_modified)."""
    return df.select(
        "path",
        "content",
        fn.extension(F.col("path")).alias("extension"),
        fn.size_bytes(F.col("content")).alias("size"),
        fn.line_count(F.col("content")).alias("line_count"),
        "last_modified",
    )


def write_files(df: DataFrame, root: str) -> None:
    """Write (rel_path, content) rows as one file each below ``root``; below a URI they are staged first."""
    source = objects.ObjectTree if objects.is_uri(root) else FileTree
    df.sparkSession.dataSource.register(source)
    with shuffles_dropped(df.sparkSession):
        df.select("rel_path", "content").write.format(source.name()).mode("append").save(root)
