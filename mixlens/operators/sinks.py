"""Writers: overwrite after validation, append, upsert by key, create if absent, a numbered build log."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlens.operators.validation import raise_if_any


#: So many folders at most are written without dealing the rows first.
FEW = 32


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows gathered by the columns that will partition their table, so that a task writes few folders and a folder has few files.
    Adaptive execution cuts what is large into tasks of the advisory size, so a value that a large part of all rows has is written
    by many tasks, and puts small values together."""
    return df.hint("rebalance", *by) if by else df


def write_checked(df: DataFrame, path: str, errors: DataFrame | None = None, columns: list[str] | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a table, once its errors are known to be none and its columns are those expected.  It is written beside
    the target first; the target is replaced by renaming, so a failure leaves the old rows as they were."""
    if columns is not None and df.columns != list(columns):
        raise ValueError(f"columns {df.columns} are not {list(columns)}")
    if errors is not None:
        raise_if_any(errors)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    dealt(df, *partition_by).write.partitionBy(*partition_by).parquet(staged)
    swap(df.sparkSession, staged, path)


def write_validated(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame], columns: list[str] | None = None, partition_by: tuple[str, ...] = (), deal: bool = True) -> None:
    """Overwrite a table with what has been checked as written: it is written beside the target, read back, and replaces
    the target only if ``check`` of the rows read finds no error; else it is deleted and the old rows stay.  Without ``deal``
    every task writes its rows where they are, a file into each folder: for few folders."""
    if columns is not None and df.columns != list(columns):
        raise ValueError(f"columns {df.columns} are not {list(columns)}")
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    (dealt(df, *partition_by) if deal else df).write.partitionBy(*partition_by).parquet(staged)
    try:
        raise_if_any(check(spark.read.schema(df.schema).parquet(staged).select(*df.columns)))
    except BaseException:
        old = spark._jvm.org.apache.hadoop.fs.Path(staged)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        raise
    swap(spark, staged, path)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs, kept = old.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, kept):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, old):
        if had:
            fs.rename(kept, old)
        raise OSError(f"cannot put {staged} in place")
    if had:
        fs.delete(kept, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def create_if_absent(df: DataFrame, path: str) -> bool:
    """Seed a table; one that is there keeps its edits."""
    if exists(df.sparkSession, path):
        return False
    df.write.parquet(path)
    return True


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The current rows with those of the changes in place of equal keys, and new keys added."""
    return current.join(changes.select(key), key, "left_anti").select(*current.columns).unionByName(changes.select(*current.columns))


def next_ids(df: DataFrame, existing: DataFrame, column: str, prefix: str, order: list[str], width: int = 6) -> DataFrame:
    """New rows with sequential ids after the greatest existing suffix.  Meant for small authoring tables: the running
    number needs one ordered partition."""
    last = existing.agg(F.coalesce(F.max(F.expr(f"try_cast(regexp_extract({column}, '^{prefix}(\\\\d+)$', 1) as int)")), F.lit(0)).alias("__last"))
    numbered = df.withColumn("__k", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last))
    return numbered.withColumn(column, F.concat(F.lit(prefix), F.lpad((F.col("__last") + F.col("__k")).cast("string"), width, "0"))).drop("__k", "__last")
