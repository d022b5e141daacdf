"""From findings to files, scores and the verdict. The one shuffle of a scan is by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import severity_label, severity_weight

CAP = 30.0
ORDER = ("start", "end", "chunk_seq", "det_ord", "f_seq")


def dedupe(findings: DataFrame) -> DataFrame:
    """Drop a finding whose predecessor by place has the same detector and span; ties keep the order of arrival."""
    order = Window.partitionBy("path").orderBy(*ORDER)
    before = F.lag(F.struct("detector", "start", "end")).over(order)
    return findings.withColumn("__same", before.eqNullSafe(F.struct("detector", "start", "end"))).where(~F.col("__same")).drop("__same")


def scores(findings: DataFrame, /, **more: Column) -> DataFrame:
    """path, n_findings, max_severity and score: severity-weighted confidences, capped for each detector.

    What `more` aggregates for each detector of a file is listed under its name.
    """
    by_detector = findings.groupBy("path", "detector").agg(
        F.sum(severity_weight(F.col("severity")) * F.col("confidence")).alias("s"), F.max("severity").alias("max_severity"), F.count("*").alias("n"), *(c.alias(name) for name, c in more.items())
    )
    return by_detector.groupBy("path").agg(F.sum("n").alias("n_findings"), F.max("max_severity").alias("max_severity"), F.sum(F.least("s", F.lit(CAP))).alias("score"), *(F.collect_list(name).alias(name) for name in more))


def files(findings: DataFrame) -> DataFrame:
    """A row for each file with findings, these in an array by place; best score first, then by path. Findings are read once."""
    one = F.struct(*ORDER, "detector", "category", "severity", "confidence", "message", "evidence")
    listed = scores(findings, findings=F.collect_list(one))
    return listed.select("path", F.sort_array(F.flatten("findings")).alias("findings"), "n_findings", "max_severity", "score").orderBy(F.desc("score"), "path")


def verdict(file_scores: DataFrame, fail_on: int) -> DataFrame:
    """One row: n_files, n_findings, max_severity (null if nothing was found) and the verdict."""
    total = file_scores.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("n_findings"), F.max("max_severity").alias("worst"))
    unsafe = F.coalesce(F.col("worst") >= fail_on, F.lit(False))
    return total.select("n_files", "n_findings", severity_label(F.col("worst")).alias("max_severity"), F.when(unsafe, "NOT SAFE").otherwise("SAFE").alias("verdict"))
