"""Choosing files by name, size and change."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of builds, caches and dependencies.
DEFAULT_EXCLUDES = [f"**/{d}/**" for d in (
    "target", "obj", "node_modules", ".next", ".nuxt", ".parcel-cache", ".turbo", "__pycache__", ".venv", "venv", ".tox", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "*.egg-info", ".gradle", ".terraform", ".serverless", ".bundle", "Pods", ".git",
)]


def glob_regex(glob: str) -> str:
    """A regular expression for a whole path. One star crosses slashes, as two do."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in {glob!r}")
    return f"^(?s:{out})$"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a path matches any of the globs."""
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def in_scope(path: Column, include: list[str], exclude: list[str], default_excludes: bool = True) -> Column:
    """Any include matches (or there is none), and no exclude does."""
    out = exclude + (DEFAULT_EXCLUDES if default_excludes else [])
    return (matches(path, include) if include else F.lit(True)) & ~matches(path, out)


def small_enough(length: Column, most: int) -> Column:
    return length <= most


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that were added, removed or have another object in one of two listings of (path, oid)."""
    both = old.select("path", F.col("oid").alias("a")).join(new.select("path", F.col("oid").alias("b")), "path", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path").distinct(), "path", "left_semi")
