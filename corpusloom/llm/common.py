"""What the operators share: shared folders, Arrow text access, ASCII case folding."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. A batch holds whole texts, so this bounds a Python worker's memory.
BATCH_ROWS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tune(spark: SparkSession) -> None:
    """Session settings the Arrow operators rely on for bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset in one process, as in tests, a temporary folder takes its place; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage, and outlives any executor."""
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")  # what this write shuffled isn't needed once it is done
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most ids that are broadcast to leave out rows: 8 MB of them.
MOST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ids (doc_id). Few ids travel to the rows; many meet them in a join.

    Rows without doc_id stay.
    """
    ids = materialise(ids.select("doc_id").where("doc_id IS NOT NULL").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII text takes the quick path of lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and others run beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; freed memory is released after the last."""
    yield from (b for b in it if b.num_rows)
    release()
