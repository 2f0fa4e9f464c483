"""Helpers the training-data operators have in common."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Where none is named, a master in this process alone gets a local one (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not configured and not sc.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tonewright-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so later stages survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Materialise as Parquet beside the checkpoints; read back column by column, and gone when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{fresh_name('rows')}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Have Spark delete shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage; a job of many short rounds would pile them up until then.
    """
    gc.collect()
    spark._jvm.System.gc()


def unused(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in any case: the name, or it with underscores before it."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store; Spark's own file systems reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc32_mod(column: Column, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo a fold count."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def whole_texts(df: DataFrame) -> DataFrame:
    """For functions over whole texts: at most 2000 rows an Arrow batch, as the usual 10,000 take tens of MB on both sides."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df


_HELD: dict = {}


def worker_state(key, make=lambda: None):
    """What an operator keeps in a worker process from task to task. Workers outlive a stage; another operator's state goes first."""
    if key not in _HELD:
        _HELD.clear()
        made = make()
        _HELD[key] = made
        give_back()
    return _HELD[key]


def give_back() -> None:
    """What this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_blocks(texts: list, limit: int = 2_000_000):
    """Ranges of a list that hold about `limit` characters each, to bound a worker's memory."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def byte_blocks(texts, limit: int):
    """Ranges of an Arrow array of strings that hold about `limit` bytes each (one text at least)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if texts.type == pa.large_string() else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    start = 0
    while start < len(texts):
        end = min(len(texts), max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1))
        yield start, end
        start = end
