"""The files of a source tree: walked with ignored folders pruned, routed to a language, and read by the tasks that need them.

Listing and reading go through Arrow's file systems (a local or mounted path, or a URI that Arrow knows), since Spark's own file sources
pass over names that begin with a dot or an underscore, which ``.env`` and ``__init__.py`` do.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from .extract import BY_EXTENSION
from .ignore import Rules

MAX_BYTES = 1 << 20
# fixed values: folders that are never indexed as a whole
UNSAFE = ("/", "/home", "/root", "/usr", "/etc", "/var", "/tmp", "/opt", "/bin", "/sbin", "/lib", "/Users", "/System", "/Library")


def assert_safe_root(root: str) -> str:
    """The root's absolute path; a system folder or the home folder itself is refused, what lies below is not."""
    full = os.path.abspath(root)
    if full in UNSAFE or full == os.path.expanduser("~"):
        raise ValueError(f"refusing to index {full}")
    return full


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _read(files: fs.FileSystem, path: str) -> bytes | None:
    """A file's content; None if it has gone since it was listed."""
    try:
        with files.open_input_stream(path) as f:
            return f.read()
    except (FileNotFoundError, OSError):
        return None


def walked(root: str) -> Iterator[tuple[str, int, float]]:
    """(path below the root, size, mtime in ms) of the files that no rule ignores. A folder's own ignore file holds for what is below it;
    an ignored folder is not entered, unless a rule may take something in it back."""
    files, base = _opened(root)
    open_ = [("", Rules())]
    while open_:
        folder, rules = open_.pop()
        entries = {e.base_name: e for e in files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))}
        own = entries.get(".gitignore")
        if own is not None and own.type == fs.FileType.File and own.size <= MAX_BYTES:
            rules = rules.add((_read(files, own.path) or b"").decode("utf-8", "replace"), folder)
        for name in sorted(entries):
            e, path = entries[name], f"{folder}/{name}".lstrip("/")
            if e.type == fs.FileType.Directory:
                if rules.keep or not rules.matches(path):
                    open_.append((path, rules))
            elif e.type == fs.FileType.File and not rules.matches(f"{folder}/env".lstrip("/") if name.startswith(".env") else path):
                yield path, e.size, (e.mtime_ns or 0) / 1e6


def kind_of(path: Column) -> Column:
    """The analyzer of a file: env files by name, others by extension; null for none."""
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    name = F.substring_index(path, "/", -1)
    return F.when(F.startswith(name, F.lit(".env")), "env").otherwise(F.try_element_at(table, extension(path)))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ms, kind, oversize) of the files below ``root`` that are not ignored and have an analyzer. The driver lists
    folders, and no more than a list of names passes through it; contents are not read."""
    rows = spark.createDataFrame(list(walked(root)), "path string, size long, mtime_ms double")
    return rows.withColumn("kind", kind_of(F.col("path"))).filter("kind is not null").withColumn("oversize", F.col("size") > MAX_BYTES)


def contents(spark: SparkSession, root: str, wanted: DataFrame, files_a_task: int = 200) -> DataFrame:
    """(path, content, hash) of the wanted files (path), read by the tasks; a file that is gone or too large drops out."""

    def run(batches):
        files, base = _opened(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content = _read(files, f"{base}/{path}")
                if content is not None and len(content) <= MAX_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    paths = wanted.select("path")
    tasks = max(1, -(-paths.count() // files_a_task))
    return paths.repartition(tasks, "path").mapInArrow(run, "path string, content binary").withColumn("hash", F.sha1("content"))
