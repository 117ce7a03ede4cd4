"""Shared plumbing of the training-data operators: input columns, shared scratch tables, bounded file broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files and tables above this size are never broadcast by the operators of this subpackage.
MAX_BROADCAST_BYTES = 64 << 20


#: Folders of sessions of one machine that name none, by application; removed when the process ends.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.  A local session that names none (tests, the benchmark) gets
    one of its own; on a cluster a missing setting is an error, as executors would write where others cannot read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="mixlens-")
            atexit.register(shutil.rmtree, folder, True)
            _own[app] = f"file://{folder}"
        root = _own[app]
    return root.rstrip("/")


#: Where ``materialize`` notes its tables, if a caller wants to delete them together later.
_notes: list[list[DataFrame]] = []


@contextmanager
def noting(tables: list[DataFrame]):
    """Note the tables that are written meanwhile."""
    _notes.append(tables)
    try:
        yield
    finally:
        _notes.remove(tables)


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back: cuts lineage, survives lost executors.  ``by``:
    columns that partition it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/mixlens-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for tables in _notes:
        tables.append(out)
    return out


def materialize_parts(spark: SparkSession, fields: T.StructType, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The same for a table that is made part by part: each is written before the next is begun."""
    path = f"{scratch_root(spark)}/mixlens-{name}-{uuid.uuid4().hex}"
    for df in parts:
        df.write.mode("append").parquet(path)
    out = spark.read.schema(fields).parquet(path)
    out.scratch_path = path
    for tables in _notes:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key (long) and text columns alone, by name: extra columns never reach an operator's plan."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(spark: SparkSession, value: bytes):
    """Broadcast bytes whose size is checked first."""
    if len(value) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{len(value)} bytes are too many to broadcast; the bound is {MAX_BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(value)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read(MAX_BROADCAST_BYTES + 1)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LONG, INT, STR, BOOL, DBL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _trim() -> None:
    """Give back what a Python worker's earlier tasks have freed: Spark keeps its workers from one stage to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has such a call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """An Arrow map that leaves its worker no larger than it has to be, and begins in such a one."""

    @wraps(run)
    def task(batches):
        _trim()
        yield from run(batches)
        _trim()

    return task


def text_batches(batches, chars: int = 2_000_000):
    """From Arrow batches of (doc_id, text): lists of keys and of texts (null: None), ``chars`` characters at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append(text := text.as_py())
            size += len(text or "")
            if size >= chars:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def chunks(batch: pa.RecordBatch, chars: int = 2_000_000, column: int = 1):
    """Offsets and numbers of rows whose texts (of one column) hold about ``chars`` bytes."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64) if batch.num_rows else np.zeros(0)
    at, total = 0, 0
    for k, n in enumerate(size.tolist()):
        total += n
        if total >= chars:
            yield at, k + 1 - at
            at, total = k + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows - at
