"""Folders for tables that a plan writes and reads again: under ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new name there.  A session of one machine that names no such folder gets one that is removed when the process ends; on a
    cluster that is an error, as executors would write where others cannot read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if app not in _own:
            own = tempfile.mkdtemp(prefix="mixlens-tables-")
            atexit.register(shutil.rmtree, own, True)
            _own[app] = f"file://{own}"
        root = _own[app]
    return f"{root.rstrip('/')}/mixlens-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written there and read again: what several branches of a plan read is made once, and a lost executor costs its
    tasks alone.  The table stays until the folder is cleaned."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
