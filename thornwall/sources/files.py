"""Working trees, repositories at a revision, and tables as files (path, content, length)."""

from __future__ import annotations

import logging
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from .git import changed_between, is_repository, tree
from .paths import in_scope, only_changed, small_enough

log = logging.getLogger("thornwall")
URLS = ("http://", "https://", "git@", "ssh://", "git://")


@dataclass
class Source:
    """A folder to scan; `close` removes a temporary clone."""

    root: str
    rev: str
    rev_explicit: bool
    temporary: str | None = field(default=None)

    def close(self) -> None:
        if self.temporary:
            shutil.rmtree(self.temporary, ignore_errors=True)


def resolve(source: str, config: ScanConfig) -> Source:
    """An existing path, or else a clone of an address."""
    if os.path.exists(source):
        return Source(os.path.realpath(source), config.rev, config.rev != "HEAD")
    if config.no_clone:
        raise FileNotFoundError(f"{source} isn't a local path, and cloning is off")
    if not source.startswith(URLS):
        raise FileNotFoundError(f"{source} is neither a path nor a repository address")
    folder = tempfile.mkdtemp(prefix="thornwall-clone-")
    try:
        subprocess.run(["git", "clone", "--quiet", "--", source, folder], check=True, capture_output=True, text=True)
    except subprocess.CalledProcessError as e:
        shutil.rmtree(folder, ignore_errors=True)
        raise RuntimeError(f"cloning {source} failed: {e.stderr.strip()}") from e
    if config.keep:
        log.warning("the clone stays in %s", folder)
    return Source(folder, config.rev, config.rev != "HEAD", None if config.keep else folder)


def working_tree(root: str) -> Iterator[tuple[str, int]]:
    """Relative path and size of files, hidden ones included; in a repository, those that git doesn't ignore."""
    names: list[str] | None = None
    if is_repository(root):
        done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
        names = sorted(set(done.stdout.decode("utf-8", "surrogateescape").split("\0")) - {""}) if done.returncode == 0 else None
    if names is None:
        names = [os.path.relpath(os.path.join(d, f), root) for d, dirs, fs in os.walk(root) for f in sorted(fs)] if os.path.isdir(root) else [""]
    for name in names:
        full = os.path.join(root, name) if name else root
        if os.path.isfile(full) and not os.path.islink(full):
            yield (name or os.path.basename(root)).replace(os.sep, "/"), os.path.getsize(full)


def listed(spark: SparkSession, names: Iterator[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(list(names), "path string, length bigint")


def read_listed(listing: DataFrame, root: str, slices: int) -> DataFrame:
    """Contents of listed files, read where the task runs; the folder must be reachable there."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                full = os.path.join(root, path) if os.path.isdir(root) else root
                with open(full, "rb") as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([len(data)])], schema=schema)

    return listing.select("path").repartition(slices).mapInArrow(run, "path string, content binary, length bigint")


def scan_files(spark: SparkSession, source: Source, config: ScanConfig) -> DataFrame:
    """Files in scope, by name and size before any content is read: of the revision, or else of the working tree."""
    keep = in_scope(F.col("path"), config.include, config.exclude, config.use_default_excludes) & small_enough(F.col("length"), config.max_binary_bytes)
    changed = None
    if config.since:
        try:
            changed = changed_between(spark, source.root, config.since, source.rev)
        except RuntimeError as e:
            log.warning("--since is ignored, everything is scanned: %s", e)
    try:
        found = tree(spark, source.root, source.rev, max(1, config.jobs)).where(keep)
    except RuntimeError as e:
        (log.warning if source.rev_explicit else log.debug)("scanning the working tree, as the revision can't be read: %s", e)
        found = read_listed(listed(spark, working_tree(source.root)).where(keep), source.root, max(1, config.jobs))
    return only_changed(found, changed) if changed is not None else found


def binary_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Files of any store that Spark reads, below a path or glob; names with a leading dot or underscore are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    return found.select("path", "content", "length")


#: Bytes of text in a task, as far as whole rows allow.
PART_BYTES = 8 << 20


def spread(table: DataFrame) -> DataFrame:
    """The rows of a table dealt out to tasks of about PART_BYTES of text, and to all cores: detectors cost far more than a shuffle.

    One row group is one task otherwise, whatever its size, and files tell little of it where texts repeat. So bytes of texts are
    summed first, which reads the table once more; the time and memory of a task don't grow with the table.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    sizes = [F.coalesce(F.sum(F.octet_length(f"`{c}`").cast("bigint")), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    size = table.agg(sum(sizes, F.lit(0)).alias("size")).first()["size"]
    return table.repartition(max(cores, -(-size // PART_BYTES)))


def table_files(table: DataFrame, path: Column, text: Column) -> DataFrame:
    """Rows of a table as files."""
    rows = spread(table.select(path.cast("string").alias("path"), text.cast("binary").alias("content")))
    return rows.where("content is not null").withColumn("length", F.octet_length("content").cast("bigint"))
