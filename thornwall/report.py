"""Reports of a finished scan: lines for people, JSON, and SARIF 2.1.0.

Text is escaped and broken on executors; only the finished report is collected.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import __version__
from .functions import safe
from .functions.text import severity_label

TOOL = "Thornwall"
#: Fixed values of SARIF.
LEVELS = {"low": "note", "medium": "warning", "high": "error", "critical": "error"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def level(severity: Column) -> Column:
    """SARIF level of a severity ordinal."""
    return F.element_at(F.array(*map(F.lit, LEVELS.values())), severity + 1)


def presented(files: DataFrame, ai_safe: bool) -> DataFrame:
    """Files with labels in place of ordinals and, on demand, everything that was copied made safe."""
    path = safe.safe_path if ai_safe else lambda c: c
    message = safe.safe_message if ai_safe else lambda c: c
    quoted = safe.safe_evidence if ai_safe else lambda c: c

    def one(f: Column) -> Column:
        return F.struct(
            f["detector"].alias("detector"),
            f["category"].alias("category"),
            severity_label(f["severity"]).alias("severity"),
            f["confidence"].alias("confidence"),
            F.struct(f["start"].alias("start"), f["end"].alias("end")).alias("span"),
            message(f["message"]).alias("message"),
            quoted(f["evidence"]).alias("evidence"),
            level(f["severity"]).alias("level"),
        )

    return files.select(path(F.col("path")).alias("path"), F.transform("findings", one).alias("findings"), severity_label(F.col("max_severity")).alias("max_severity"), "score", "n_findings")


def human_lines(files: DataFrame, ai_safe: bool = False) -> DataFrame:
    """path, score, line_no and line of the part of the report that lists files."""

    def lines(f: Column) -> Column:
        where = F.concat(F.lit("  ["), f["severity"], F.lit("] "), f["detector"], F.lit(" @ "), f["span"]["start"], F.lit(".."), f["span"]["end"], F.lit(": "), f["message"])
        return F.array(where, F.concat(F.lit("    evidence: "), f["evidence"]))

    head = F.array(F.lit(""), F.col("path"), F.concat(F.lit("  score "), F.format_string("%.2f", F.col("score").cast("double")), F.lit(", max severity "), F.coalesce("max_severity", F.lit("none"))))
    rows = presented(files, ai_safe)
    return rows.select("path", "score", F.posexplode(F.concat(head, F.flatten(F.transform("findings", lines)))).alias("line_no", "line"))


def human(files: DataFrame, verdict: dict[str, Any], ai_safe: bool = False) -> str:
    out = [safe.PREAMBLE] if ai_safe else []
    out.append(f"{TOOL} — verdict: {verdict['verdict']} ({verdict['n_findings']} finding(s) across {verdict['n_files']} file(s))")
    out += [f"max severity: {verdict['max_severity']}"] if verdict["max_severity"] else []
    rows = human_lines(files, ai_safe).orderBy(F.desc("score"), "path", "line_no")
    return "\n".join([*out, *(r["line"] for r in rows.toLocalIterator())]) + "\n"


def _single(x: float) -> float:
    """The shortest decimal number that is the same 32-bit number."""
    return float(str(np.float32(x)))


def _file(r: Any, number) -> dict[str, Any]:  # noqa: ANN001
    found = [
        {
            "detector": f["detector"], "category": f["category"], "severity": f["severity"], "confidence": number(f["confidence"]), "path": r["path"],
            "span": {"start": f["span"]["start"], "end": f["span"]["end"]}, "message": f["message"], "evidence": f["evidence"],
        }
        for f in r["findings"]
    ]
    return {"path": r["path"], "findings": found, "max_severity": r["max_severity"], "score": number(r["score"])}


def to_json(files: DataFrame, verdict: dict[str, Any], ai_safe: bool = False) -> str:
    rows = presented(files, ai_safe).orderBy(F.desc("score"), "path").collect()
    number = (lambda x: float(np.float32(x))) if ai_safe else _single
    out: dict[str, Any] = {"files": [_file(r, number) for r in rows], "max_severity": verdict["max_severity"], "verdict": verdict["verdict"].lower().replace(" ", "_")}
    if ai_safe:
        out |= {"safe_view": True, "ai_safe_preamble": safe.PREAMBLE}
    return json.dumps(out, indent=2, ensure_ascii=False)


def to_sarif(files: DataFrame, ai_safe: bool = False) -> str:
    """One rule for each detector that found something, in alphabetical order, and one result for each finding."""
    rows = presented(files, ai_safe).orderBy(F.desc("score"), "path").collect()
    names = sorted({f["detector"] for r in rows for f in r["findings"]})
    index = {n: i for i, n in enumerate(names)}
    results = [
        {
            "ruleId": f["detector"],
            "ruleIndex": index[f["detector"]],
            "level": f["level"],
            "message": {"text": f["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"].replace("\\", "/")}, "region": {"byteOffset": f["span"]["start"], "byteLength": max(0, f["span"]["end"] - f["span"]["start"])}}}],
            "properties": {"category": f["category"], "confidence": float(np.float32(f["confidence"])), "severity": f["severity"], "evidence": f["evidence"]},
        }
        for r in rows
        for f in r["findings"]
    ]
    driver: dict[str, Any] = {"name": TOOL, "version": __version__, "rules": [{"id": n, "name": n, "shortDescription": {"text": f"{TOOL} {n} detector"}, "defaultConfiguration": {"level": "warning"}} for n in names]}
    if ai_safe:
        driver["properties"] = {"safeView": True, "aiSafePreamble": safe.PREAMBLE}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, ensure_ascii=False)
