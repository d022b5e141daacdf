"""Repositories as a data source: the tree of a revision in parallel slices of paths."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThanOrEqual

FORMAT = "git_tree"
SCHEMA = "path string, oid string, length bigint, content binary"


def _git(root: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


def is_repository(root: str) -> bool:
    try:
        return os.path.isdir(root) and os.path.realpath(_git(root, "rev-parse", "--show-toplevel").decode().strip() or root) == os.path.realpath(root)
    except (RuntimeError, OSError):
        return False


def listing(root: str, rev: str) -> list[tuple[str, str, int]]:
    """Path, object and size of every file of a revision; links count as files that hold their target."""
    if not is_repository(root):
        raise RuntimeError(f"{root} isn't a repository")
    if rev.startswith("-"):
        raise RuntimeError(f"{rev} isn't a revision")
    rows = []
    for line in _git(root, "ls-tree", "-r", "-z", "-l", rev).decode("utf-8", "surrogateescape").split("\0"):
        if line:
            head, _, path = line.partition("\t")
            _, kind, oid, size = head.split()
            if kind == "blob":
                rows.append((path, oid, int(size)))
    return rows


class Slice(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.rows = rows


class TreeReader(DataSourceReader):
    """Reads blobs through one batch process for each slice. Size limits and single paths are pushed down."""

    def __init__(self, options: dict) -> None:
        self.root, self.rev, self.slices = options["path"], options.get("rev", "HEAD"), int(options.get("slices", "8"))
        self.most: int | None = None
        self.path: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("length",):
                self.most = f.value if self.most is None else min(self.most, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and self.path in (None, f.value):
                self.path = f.value
            else:
                yield f

    def partitions(self) -> list[Slice]:
        rows = [r for r in listing(self.root, self.rev) if (self.most is None or r[2] <= self.most) and (self.path is None or r[0] == self.path)]
        n = max(1, min(self.slices, len(rows)))
        return [Slice(rows[i::n]) for i in range(n)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
            for path, oid, size in partition.rows:
                run.stdin.write(oid.encode() + b"\n")
                run.stdin.flush()
                head = run.stdout.readline().split()
                if len(head) == 3:
                    data = run.stdout.read(int(head[2]))
                    run.stdout.read(1)
                    yield path, oid, size, data
            run.stdin.close()


class TreeSource(DataSource):
    """spark.read.format("git_tree").option("rev", ...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, rev: str, slices: int = 8) -> DataFrame:
    """Files of a revision (path, content, length, oid). Raises RuntimeError if there is no such revision."""
    listing(root, rev)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format(FORMAT).option("rev", rev).option("slices", str(slices)).load(root).select("path", "content", "length", "oid")


def changed_between(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """Paths that differ between two revisions."""
    from .paths import changed_paths

    frames = [spark.createDataFrame([(p, o) for p, o, _ in listing(root, rev)], "path string, oid string") for rev in (old, new)]
    return changed_paths(*frames)
