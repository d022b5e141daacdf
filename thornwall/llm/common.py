"""Helpers that the operators share: shared storage, Arrow mapping, safe column access."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word definition: space, tab, line feed, vertical tab, form feed, return.
#: bytes.split() cuts at exactly these, so UTF-8 bytes are split rather than str.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes of text that Python objects exist for at a time.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch where the session has Spark's default, which would be 10,000 texts of any length.
BATCH_ROWS = 1000
#: Row groups of intermediate tables, which a task holds in memory while it writes.
BLOCK_BYTES = 16 << 20
#: Folder of each materialised table that is in use.
_PLACES: dict[int, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Only where that setting is absent and all runs in one process (tests) a local folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="thornwall-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/thornwall/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str | None:
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    return there.get() if there.isDefined() else None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = path
    weakref.finalize(out, _PLACES.pop, id(out), None)
    return out


def remove_table(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        if path := _PLACES.pop(id(table), None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that plans of ended jobs go, and with them their broadcasts and shuffles.

    The JVM holds on to a heap that has grown until a full collection; stages of many small jobs have few by themselves.
    """
    gc.collect()  # objects here keep those of the JVM
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (f"__{name}{i or ''}" for i in itertools.count()) if c.lower() not in taken)


def column(df: DataFrame, name: str, kind: str):
    """A column by its exact name, cast; null if the table lacks it. Other columns never matter."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, unless it sets a number itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null stays null), whatever else the table has."""
    small_batches(df.sparkSession)
    return df.select(column(df, id_col, "long").alias("doc_id"), column(df, text_col, "string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of one batch; Spark bounds a batch by rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that Python objects exist for few rows, and few bytes of text, at a time.

    A row of more than `most` bytes is a part of its own.
    """
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(before, before[at] + most, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
