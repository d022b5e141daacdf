"""Findings of files as they arrive. An extension: the batch scan has no counterpart of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..operators import aggregate, quarantine
from ..operators.chunk import chunk, prose
from ..operators.engine import findings, detectors
from ..operators.extract import extract
from ..schema import FILES


def incoming_findings(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Findings of a stream of files; extraction, windows and detectors keep no state."""
    return findings(chunk(extract(files)), detectors(config.detectors))


def incoming_rows(table: DataFrame, path: str, text: str, config: ScanConfig) -> DataFrame:
    """Findings of a stream of table rows, each text one prose file."""
    return findings(chunk(prose(table, F.col(path), F.col(text))), detectors(config.detectors))


def scores_to(found: DataFrame, folder: str, checkpoint: str, reviewed: list[dict] | None = None) -> StreamingQuery:
    """Write deduplicated scores of each batch of new files below `folder`, a sub-folder for each batch.

    Dropping repeats looks at the finding before, which streams can't, so it happens batch by batch; a file arrives
    in one batch. A batch that runs again replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        if reviewed:
            batch = quarantine.suppress(batch, quarantine.entries(batch.sparkSession, {"ignore": reviewed}))
        aggregate.scores(aggregate.dedupe(batch)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, each once, as (path, content, length)."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return found.select(*(F.col(f.name) for f in FILES))
