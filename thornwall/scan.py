"""A whole scan: source, extraction, windows, detectors, review list, scores, verdict."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .config import ScanConfig
from .operators import aggregate, quarantine
from .operators.chunk import chunk
from .operators.engine import scan_chunks
from .operators.extract import extract
from .report import human, to_json, to_sarif
from .sources.files import resolve, scan_files

log = logging.getLogger("thornwall")


@dataclass
class Report:
    """Files with findings, and the verdict as a dictionary."""

    files: DataFrame
    verdict: dict[str, Any]

    @property
    def unsafe(self) -> bool:
        return self.verdict["verdict"] != "SAFE"

    def render(self, form: str = "human", ai_safe: bool = False) -> str:
        if form == "json":
            return to_json(self.files, self.verdict, ai_safe)
        return to_sarif(self.files, ai_safe) if form == "sarif" else human(self.files, self.verdict, ai_safe)


def findings_of(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Findings of files (path, content, length), one narrow pass over them."""
    return scan_chunks(chunk(extract(files)), config.detectors)


def report_of(findings: DataFrame, fail_on: int) -> Report:
    found = aggregate.dedupe(findings)
    return Report(aggregate.files(found), aggregate.verdict(aggregate.scores(found), fail_on).first().asDict())


def scan(spark: SparkSession, source: str, config: ScanConfig) -> Report:
    """Scan a path or an address. With `quarantine` set, all findings go to the review list and the verdict is SAFE."""
    place = resolve(source, config)
    try:
        try:
            reviewed = quarantine.load(config.ignore_file)
        except (OSError, ValueError) as e:
            log.warning("the review list can't be read, so nothing is suppressed: %s", e)
            reviewed = {"version": quarantine.VERSION, "generated_at": None, "ignore": []}
        found = findings_of(scan_files(spark, place, config), config).persist()
        listed = quarantine.entries(spark, reviewed)
        if config.quarantine:
            quarantine.save(config.ignore_file, quarantine.append(reviewed, quarantine.new_entries(found, listed)))
            found = found.limit(0)
        elif reviewed["ignore"]:
            found = quarantine.suppress(found, listed)
        report = report_of(found, config.fail_on)
        report.files = report.files.persist()
        report.files.count()
        return report
    finally:
        place.close()
