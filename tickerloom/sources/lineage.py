"""Reliable checkpoints for iterative queries and streams."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master a temporary one, if none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tickerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared checkpoint folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder that nothing has used, below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def few_or_shuffled(ids: DataFrame) -> DataFrame:
    """Narrow rows, kept by ``cut_lineage``, marked for a broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


#: Bytes of an Arrow batch between the JVM and a Python worker, where the session doesn't set its own.
ARROW_BYTES = 4 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, whatever the length of texts; the worker gives its memory back at the end of a task."""
    spark = df.sparkSession
    if spark.conf.get(_ARROW_CONF, None) in (None, "-1"):
        spark.conf.set(_ARROW_CONF, str(ARROW_BYTES))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(frugal, schema)
