"""The bridge over arriving facts: each fact joins the current mapping as it comes, and repeated deliveries are dropped.

The mapping is a static side and small; the only state is the set of recent fact ids, bounded by the watermark.  It is kept in
RocksDB: on disk, with a fixed share of memory, so that the ids of a large delivery need not fit an executor's heap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mixlens.operators.aggregates import measures
from mixlens.operators.bridge import counted_bridge, metric_bridge

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def stream_bridge(facts: DataFrame, effective: DataFrame, arrived: str = "arrived_at", late: str = "1 day") -> DataFrame:
    """Bridge rows of a stream of facts, each fact id once within the watermark; counted ones, if the mapping is (``mapping.decisions``)."""
    once = facts.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["sales_fact_id"])
    return counted_bridge(once, effective) if "copies" in effective.columns else metric_bridge(once, effective)


def start(facts: DataFrame, effective: DataFrame, path: str, checkpoint: str, arrived: str = "arrived_at", available_now: bool = True) -> StreamingQuery:
    """Append bridge rows to a table, by import."""
    writer = stream_bridge(facts, effective, arrived).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("import_id")
    conf = facts.sparkSession.conf
    before = {key: conf.get(key, None) for key in STATE}
    try:
        for key, value in STATE.items():
            conf.set(key, value)
        return (writer.trigger(availableNow=True) if available_now else writer).start()  # a stream keeps the settings it starts with
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def windowed_totals(facts: DataFrame, arrived: str = "arrived_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts, sales and quantity by window of arrival and publication state."""
    return facts.withWatermark(arrived, late).groupBy(F.window(arrived, width), "publication_state").agg(*measures())
