"""What the operators of this package share: reliable checkpoints and a few native expressions."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


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
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared checkpoint folder; survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts(spark: SparkSession, per: int = 1) -> int:
    """Shuffle partitions of the session, times ``per``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that by itself where every code point is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def about(rate: float, salt: int, *columns: str) -> Column:
    """True for about a share of ``rate`` of the rows, by 60 bits of a hash of their columns; so fine that no rate rounds to 0."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *columns), 4) < int(min(1.0, rate) * (1 << 60))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator's own outputs replace, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id isn't among ``ids`` (one column, kept by ``cut_lineage``); null ids stay."""
    ids = ids.toDF("__gone")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("__gone"), "left_anti")


#: Bytes of an Arrow batch between the JVM and a Python worker, where the session doesn't set its own.
ARROW_BYTES = 4 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system: a Python worker keeps it while it waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size, whatever the length of texts; the worker gives its memory back at the end of a task."""
    spark = df.sparkSession
    if spark.conf.get(_ARROW_CONF, None) is None:
        spark.conf.set(_ARROW_CONF, str(ARROW_BYTES))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(frugal, schema)


def fit_in_task(sample: DataFrame, fit):
    """``fit`` of a bounded sample, as a dict of columns, in one task; its pickled result comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        columns = table.to_pydict() if table is not None else {name: [] for name in names}
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(columns))]}, schema=pa.schema([("model", pa.binary())]))

    names = sample.columns
    found = map_batches(sample.repartition(1), run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit({name: [] for name in names})  # no rows may mean no task
