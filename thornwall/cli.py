"""Command line: python -m thornwall.cli SOURCE [options]. Exit 0: safe; 1: not safe; 2: an error."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .config import ScanConfig
from .schema import SEVERITIES, parse_severity


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thornwall", description="Scan a folder or repository for prompt injection.")
    p.add_argument("source", help="a local path or a repository address")
    p.add_argument("--rev", default="HEAD", help="revision to scan")
    p.add_argument("--config", help="a TOML file")
    p.add_argument("--format", choices=("human", "json", "sarif"), default="human")
    p.add_argument("--fail-on", choices=SEVERITIES, help="lowest severity that fails (medium)")
    p.add_argument("--include", action="append", default=[], help="scan only matching paths; may be repeated")
    p.add_argument("--exclude", action="append", default=[], help="leave matching paths out; may be repeated")
    p.add_argument("--no-clone", action="store_true", help="take local paths only")
    p.add_argument("--keep", action="store_true", help="keep a temporary clone")
    p.add_argument("--since", help="scan only files changed between this revision and --rev")
    p.add_argument("--quarantine", action="store_true", help="add findings to the review list instead of failing")
    p.add_argument("--ignore-file", default=".thornwall-ignore", help="the review list")
    p.add_argument("-q", "--quiet", action="store_true", help="say nothing but errors beside the report")
    p.add_argument("--no-default-excludes", action="store_true", help="scan build and dependency folders too")
    p.add_argument("--ai-safe", action="store_true", help="make the report safe for a language model to read")
    p.add_argument("--jobs", type=int, help="slices that files are read in")
    return p


def settings(args: argparse.Namespace) -> ScanConfig:
    """Defaults, then the file, then the command line; lists add up."""
    config = ScanConfig()
    if args.config:
        config.merge_file(args.config)
    config.rev, config.no_clone, config.keep, config.since = args.rev, args.no_clone, args.keep, args.since
    config.quarantine, config.ignore_file, config.quiet = args.quarantine, args.ignore_file, args.quiet
    config.use_default_excludes = not args.no_default_excludes
    config.include += args.include
    config.exclude += args.exclude
    if args.fail_on:
        config.fail_on = parse_severity(args.fail_on)
    if args.jobs:
        config.jobs = args.jobs
    return config


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.WARNING, format="%(levelname)s: %(message)s", stream=sys.stderr)
    from .scan import scan

    try:
        config = settings(args)
        spark = SparkSession.builder.appName("thornwall").config("spark.ui.showConsoleProgress", str(not args.quiet).lower()).getOrCreate()
        report = scan(spark, args.source, config)
        print(report.render(args.format, args.ai_safe))
    except Exception as e:  # noqa: BLE001  any failure is exit code 2
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 1 if report.unsafe else 0


if __name__ == "__main__":
    sys.exit(main())
