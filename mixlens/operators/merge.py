"""Keyed changes to a stored table: only the partitions that a change touches are written anew.

The rows of those partitions are staged beside the table and checked.  Then a manifest is written that names them; from that
moment the merge counts as done.  Each partition is put in place by renaming, and the manifest goes last.  A merge that fails
before its manifest leaves the table as it was; one that fails after is finished by ``recover``, which every merge calls first.
All other partitions keep their files.  One merge runs at a time; a reader during the renames may see some partitions
new and others old.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.operators.sinks import dealt
from mixlens.operators.validation import raise_if_any


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, a = _fs(spark, old)
    b = _fs(spark, new)[1]
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot move {old}")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}.merge.json"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all."""
    fs, p = _fs(spark, f"{path}.part")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(p, _fs(spark, path)[1]):
        raise OSError(f"cannot write {path}")


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _directory(spark: SparkSession, column: str, value: str | None) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a merge whose manifest is there: whatever is still staged goes in place, the old files go."""
    manifest = _manifest(path)
    if not _exists(spark, manifest):
        return False
    plan = json.loads(_read_text(spark, manifest))
    for name in plan["removed"]:  # partitions that have lost all their rows
        if _exists(spark, f"{path}/{name}"):
            _rename(spark, f"{path}/{name}", f"{plan['old']}/{name}")
    for name in plan["written"]:  # what is no longer staged is in place
        place, staged = f"{path}/{name}", f"{plan['staged']}/{name}"
        if _exists(spark, staged):
            if _exists(spark, place):
                _rename(spark, place, f"{plan['old']}/{name}")
            _rename(spark, staged, place)
    _delete(spark, plan["staged"])
    _delete(spark, plan["old"])
    _delete(spark, manifest)
    return True


def merge(changes: DataFrame, path: str, key: list[str], partition: str, deleted: Column | None = None, check: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """Put each change in place of the row with its key, or add it; a row for which ``deleted`` holds takes its key's row out.  A key
    may move to another partition.  A key that changes twice, or is null, is an error.  ``check`` gives the errors of the rows staged.  Gives
    the folders of the partitions written.  The table is Parquet, partitioned by one column of text, whole numbers or dates."""
    spark = changes.sparkSession
    recover(spark, path)
    current = spark.read.parquet(path)
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    rows = changes.withColumn("_gone", gone).select(*current.columns, "_gone")
    wrong = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | ~_known(key))
    raise_if_any(wrong.select(F.lit("merge-key").alias("check_id"), F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("entity_id"), F.lit("null, or changed more than once").alias("message")))
    # the partitions that hold a changed key, or will hold one: as many values as there are folders at most
    value = F.col(partition).cast("string").alias("v")
    held = current.join(rows.select(*key), key, "left_semi").select(value)
    touched = [r["v"] for r in held.union(rows.where("NOT _gone").select(value)).distinct().collect()]
    if not touched:
        return []
    inside = F.col(partition).cast("string").isin([v for v in touched if v is not None]) | (F.col(partition).isNull() if None in touched else F.lit(False))
    made = current.where(inside).join(rows.select(*key), key, "left_anti").select(*current.columns).unionByName(rows.where("NOT _gone").drop("_gone"))
    mark = uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.staged-{mark}", f"{path.rstrip('/')}.old-{mark}"
    try:
        dealt(made, partition).write.partitionBy(partition).parquet(staged)
        if check is not None:
            raise_if_any(check(spark.read.schema(current.schema).parquet(staged).select(*current.columns)))
        names = sorted(_directory(spark, partition, v) for v in touched)
        there = {n: _exists(spark, f"{staged}/{n}") for n in names}
        _write_text(spark, _manifest(path), json.dumps({"staged": staged, "old": old, "written": [n for n in names if there[n]], "removed": [n for n in names if not there[n]]}))
    except BaseException:
        if not _exists(spark, _manifest(path)):
            _delete(spark, staged)
        raise
    recover(spark, path)
    return names


def _known(key: list[str]) -> Column:
    known = F.col(key[0]).isNotNull()
    for k in key[1:]:
        known = known & F.col(k).isNotNull()
    return known
