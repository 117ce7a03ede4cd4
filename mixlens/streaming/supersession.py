"""A scope cube that follows imports as they are published, superseded and reinstated, without ever reading old facts again.

The stream brings facts and the states of imports.  Each batch leaves three small tables under its number, so a batch that is
repeated after a failure writes the same again:

* ``sums``: counts, sales and quantity of its new facts by import, channel and group;
* ``states``: the states it brought, each with its version;
* ``changes``: what the cube gains or loses.  New facts of an active import add their sums.  An import that turns active adds, and one
  that turns superseded takes back, the sums of all earlier batches.

A fact counts once: ids seen are kept by import and batch, and a batch meets only those of the imports it brings, however late a
repeat comes.  The state with the greatest version holds, so states may come late or twice; an import of which no state is known is
not active.  Facts that come late for a superseded import enter ``sums`` and appear if it is reinstated.

``compact`` puts all batches before one into a base of few files, so what a batch reads follows the imports and their cells, not the
number of batches since the stream began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mixlens import schema as S
from mixlens.operators.sinks import dealt

KEYS = ["import_id", "reporting_channel", "reporting_group_id"]
MEASURES = {"fact_count": "long", "sales_nok": "decimal(38,2)", "quantity": "decimal(38,2)"}
#: A row of the stream: a fact (state columns null) or a state (fact columns null).
EVENTS = "import_id string, sales_fact_id string, reporting_channel string, reporting_group_id string, sales_amount decimal(18,2), quantity decimal(18,2), publication_state string, version long"
_SUMS = ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{k} {t}" for k, t in MEASURES.items()) + ", batch_id long"
_STATES, _SEEN = "import_id string, version long, active boolean, batch_id long", "sales_fact_id string, batch_id long, import_id string"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, column: str) -> list[int]:
    """The numbers of the folders ``column=number`` of a path."""
    fs, p = _place(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{column}="))


def compacted(spark: SparkSession, path: str) -> int:
    """The first batch that the base does not hold; 0 without a base.  A base counts once its mark is there."""
    whole = [n for n in _numbers(spark, f"{path}/base", "upto") if (at := _place(spark, f"{path}/base/upto={n}/_whole"))[0].exists(at[1])]
    return max(whole, default=0)


def _stored(spark: SparkSession, path: str, name: str, fields: str) -> DataFrame:
    """All batches of a table, those of the base as one; none before the first."""
    upto, rows = compacted(spark, path), spark.createDataFrame([], fields)
    if _numbers(spark, f"{path}/{name}", "batch_id"):
        rows = spark.read.schema(fields).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").where(F.col("batch_id") >= upto)
    if upto:
        rows = spark.read.schema(fields).parquet(f"{path}/base/upto={upto}/{name}").unionByName(rows)
    return rows


def _write(df: DataFrame, path: str, name: str, batch: int, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}/batch_id={batch}")


def _active(states: DataFrame) -> DataFrame:
    """``import_id`` of the imports whose latest state is active."""
    return states.groupBy("import_id").agg(F.max_by("active", "version").alias("active")).where("active").select("import_id")


def _measures() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    return [F.count(F.lit(1)).alias("fact_count"), total("sales_amount").alias("sales_nok"), total("quantity").alias("quantity")]


def apply(batch: DataFrame, number: int, path: str) -> None:
    """Take one batch in."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        brought = batch.where("sales_fact_id IS NOT NULL")
        imports = brought.select("import_id").distinct()
        seen = _stored(spark, path, "seen", _SEEN).where(F.col("batch_id") < number).join(imports, "import_id", "left_semi").select("import_id", "sales_fact_id")
        new = brought.dropDuplicates(["import_id", "sales_fact_id"]).join(seen, ["import_id", "sales_fact_id"], "left_anti").persist()
        _write(new.select("sales_fact_id", "import_id"), path, "seen", number, ("import_id",))
        _write(new.groupBy(*KEYS).agg(*_measures()), path, "sums", number)
        new.unpersist()
        told = batch.where("sales_fact_id IS NULL AND publication_state IS NOT NULL")
        told = told.select("import_id", "version", (F.trim("publication_state") == S.ACTIVE_FINALIZED).alias("active"))
        _write(told, path, "states", number)
        states, sums = _stored(spark, path, "states", _STATES).where(F.col("batch_id") <= number), _stored(spark, path, "sums", _SUMS)
        before, after = _active(states.where(F.col("batch_id") < number)), _active(states)
        turned = before.select("import_id", F.lit(-1).alias("sign")).join(after, "import_id", "left_anti").unionByName(after.select("import_id", F.lit(1).alias("sign")).join(before, "import_id", "left_anti"))
        old = sums.where(F.col("batch_id") < number).join(turned, "import_id")
        here = sums.where(F.col("batch_id") == number).join(after, "import_id", "left_semi").withColumn("sign", F.lit(1))
        moved = old.select(*KEYS, *MEASURES, "sign").unionByName(here.select(*KEYS, *MEASURES, "sign"))
        signed = moved.groupBy(*KEYS).agg(*(F.sum(F.col(c) * F.col("sign")).cast(t).alias(c) for c, t in MEASURES.items()))
        _write(signed, path, "changes", number)
    finally:
        batch.unpersist()


def _mark(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, f"{path}/_whole")
    fs.create(p, True).close()


def compact(spark: SparkSession, path: str, number: int) -> bool:
    """Put the batches before ``number`` into a new base: sums and changes added up by cell, the latest state of each import, the ids
    seen by import.  Batches from ``number`` on, which may yet be repeated, stay as they are.  The base is written whole, then
    marked, then what it holds is deleted; a failure before the mark leaves the old base and its batches valid, one after it leaves
    only folders that nothing reads and the next call deletes.  It runs between batches, by the process that applies them."""
    upto = compacted(spark, path)
    if number > upto:
        place = f"{path}/base/upto={number}"
        last, before = F.lit(number - 1).cast("long").alias("batch_id"), F.col("batch_id") < number
        added = [F.sum(c).cast(t).alias(c) for c, t in MEASURES.items()]
        for name in ("sums", "changes"):
            cells = _stored(spark, path, name, _SUMS).where(before).groupBy(*KEYS).agg(*added)
            cells.select(*KEYS, *MEASURES, last).write.mode("overwrite").parquet(f"{place}/{name}")
        states = _stored(spark, path, "states", _STATES).where(before).groupBy("import_id").agg(F.max("version").alias("version"), F.max_by("active", "version").alias("active"))
        states.select("import_id", "version", "active", last).write.mode("overwrite").parquet(f"{place}/states")
        seen = dealt(_stored(spark, path, "seen", _SEEN).where(before).select("sales_fact_id", last, "import_id"), "import_id")
        seen.write.mode("overwrite").partitionBy("import_id").parquet(f"{place}/seen")
        _mark(spark, place)
    upto = max(upto, number)
    gone = [f"{path}/{name}/batch_id={n}" for name in ("sums", "states", "changes", "seen") for n in _numbers(spark, f"{path}/{name}", "batch_id") if n < upto]
    gone += [f"{path}/base/upto={n}" for n in _numbers(spark, f"{path}/base", "upto") if n != upto]
    for old in gone:
        fs, p = _place(spark, old)
        fs.delete(p, True)
    return bool(gone)


def start(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, compact_every: int = 0) -> StreamingQuery:
    """Follow a stream of ``EVENTS`` into the tables under ``path``; with ``compact_every``, all but the last batch are compacted after
    each so many."""

    def take(batch: DataFrame, number: int) -> None:
        apply(batch, number, path)
        if compact_every and number and number % compact_every == 0:
            compact(batch.sparkSession, path, number)

    writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube as it stands: by import, channel and group, active imports alone.  It reads changes, never facts."""
    rows = _stored(spark, path, "changes", _SUMS)
    out = rows.groupBy(*KEYS).agg(*(F.sum(c).cast(t).alias(c) for c, t in MEASURES.items()))
    return out.where("fact_count <> 0")


def recomputed(events: DataFrame) -> DataFrame:
    """The same from all events at once."""
    facts = events.where("sales_fact_id IS NOT NULL").dropDuplicates(["import_id", "sales_fact_id"])
    states = events.where("sales_fact_id IS NULL AND publication_state IS NOT NULL").select("import_id", "version", (F.trim("publication_state") == S.ACTIVE_FINALIZED).alias("active"))
    return facts.join(_active(states), "import_id", "left_semi").groupBy(*KEYS).agg(*_measures())
