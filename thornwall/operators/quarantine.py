"""Findings that a person has reviewed: suppressing them, and adding new ones to the list."""

from __future__ import annotations

import json
import os
import tomllib
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fnv1a64_hex

VERSION = 1
ENTRY = "detector string, path string, message string, evidence_hash string, note string"
#: Entries up to which the list is broadcast; a longer one is joined by a shuffle.
BROADCAST_ENTRIES = 200_000


def load(path: str) -> dict:
    """The list as {version, generated_at, ignore}; empty if there is no such file."""
    if not os.path.exists(path):
        return {"version": VERSION, "generated_at": None, "ignore": []}
    with open(path, "rb") as f:
        data = tomllib.load(f)
    entries = [{k: e.get(k) for k in ("detector", "path", "message", "evidence_hash", "note")} for e in data.get("ignore", [])]
    if any(e[k] is None for e in entries for k in ("detector", "path", "message", "evidence_hash")):
        raise ValueError(f"an entry of {path} lacks a field")
    return {"version": data.get("version", VERSION), "generated_at": data.get("generated_at"), "ignore": entries}


def save(path: str, data: dict) -> None:
    """Write the list as TOML, making its folder if need be."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    quote = lambda s: json.dumps(s, ensure_ascii=False).replace("\x7f", "\\u007f")
    lines = [f"version = {data['version']}"] + ([f"generated_at = {quote(data['generated_at'])}"] if data.get("generated_at") else [])
    for e in data["ignore"]:
        lines += ["", "[[ignore]]", *(f"{k} = {quote(e[k])}" for k in ("detector", "path", "message", "evidence_hash", "note") if e.get(k) is not None)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def entries(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame([tuple(e.get(k) for k in ("detector", "path", "message", "evidence_hash", "note")) for e in data["ignore"]], ENTRY)


def _path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def keyed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("__path", _path(F.col("path"))).withColumn("__hash", fnv1a64_hex(F.col("evidence")))


def suppress(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Findings without those that equal a reviewed one in detector, path, message and evidence, wherever they stand."""
    known = reviewed.select(F.col("detector").alias("__d"), F.col("path").alias("__p"), F.col("message").alias("__m"), F.col("evidence_hash").alias("__h")).distinct()
    side = F.broadcast(known) if known.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES else known
    same = (F.col("detector") == F.col("__d")) & (F.col("__path") == F.col("__p")) & (F.col("message") == F.col("__m")) & (F.col("__hash") == F.col("__h"))
    return keyed(findings).join(side, same, "left_anti").drop("__path", "__hash")


def new_entries(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Entries for findings that aren't listed without a note; equal ones of this batch are all kept, in order."""
    rows = keyed(findings).select("path", "chunk_seq", "det_ord", "f_seq", "detector", "__path", "message", "__hash")
    known = reviewed.where("note is null").select(F.col("detector").alias("__d"), F.col("path").alias("__p"), F.col("message").alias("__m"), F.col("evidence_hash").alias("__h"))
    same = (F.col("detector") == F.col("__d")) & (F.col("__path") == F.col("__p")) & (F.col("message") == F.col("__m")) & (F.col("__hash") == F.col("__h"))
    fresh = rows.join(known, same, "left_anti").orderBy("path", "chunk_seq", "det_ord", "f_seq")
    return fresh.select("detector", F.col("__path").alias("path"), "message", F.col("__hash").alias("evidence_hash"), F.lit(None).cast("string").alias("note"))


def append(data: dict, fresh: DataFrame) -> dict:
    """The list with new entries, for review by a person; they all go into one file on the driver."""
    added = [r.asDict() for r in fresh.toLocalIterator()]
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"version": VERSION, "generated_at": now, "ignore": [*data["ignore"], *added]}
