"""The bridge: one row a fact, with the mapping of its product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens import schema as S


def metric_bridge(facts: DataFrame, effective: DataFrame, fingerprint: Column | str = "", refreshed_at: Column | None = None) -> DataFrame:
    """Facts joined to the mapping, all facts kept; what has no mapping gets nulls, which ``validation`` reports.  The
    mapping is the dimension: Catalyst broadcasts it below the threshold and shuffles by product beyond."""
    mapping = effective.select("product_id", "effective_reporting_group_id", "effective_reporting_group_name", "resolution_source", "resolution_state", "resolution_status", "winning_rule_id", F.col("as_of_date").alias("mapping_as_of_date"))
    rows = facts.join(mapping, "product_id", "left")
    mark = fingerprint if isinstance(fingerprint, Column) else F.lit(fingerprint)
    when = refreshed_at if refreshed_at is not None else F.lit(None).cast("timestamp")
    return rows.withColumn("mapping_fingerprint", mark).withColumn("metric_refresh_at", when).select(*S.BRIDGE)


def counted_bridge(facts: DataFrame, decisions: DataFrame, fingerprint: Column | str = "", refreshed_at: Column | None = None) -> DataFrame:
    """The bridge with one row a fact and decision, and ``copies``, how many rows of the bridge it stands for: as many as products
    with its id that have this decision (``mapping.decisions``, ``mapping.counted``), once for a fact without a mapping."""
    mapping = decisions.select("product_id", "effective_reporting_group_id", "effective_reporting_group_name", "resolution_source", "resolution_state", "resolution_status", "winning_rule_id", F.col("as_of_date").alias("mapping_as_of_date"), "copies")
    rows = facts.join(mapping, "product_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("int"))
    mark = fingerprint if isinstance(fingerprint, Column) else F.lit(fingerprint)
    when = refreshed_at if refreshed_at is not None else F.lit(None).cast("timestamp")
    return rows.withColumn("mapping_fingerprint", mark).withColumn("metric_refresh_at", when).select(*S.BRIDGE, "copies")


def expanded(rows: DataFrame) -> DataFrame:
    """All rows of a bridge that holds ``copies``; another bridge as it is."""
    if "copies" not in rows.columns:
        return rows
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_", "copies")


def metric_bridge_as_of(facts: DataFrame, effective: DataFrame, day: str = "fact_date", fingerprint: Column | str = "", refreshed_at: Column | None = None) -> DataFrame:
    """The bridge in which each fact has the mapping of its product on the fact's own day (``mapping.resolve_as_of``)."""
    mapping = effective.select("product_id", F.col("as_of_date").alias(day), "effective_reporting_group_id", "effective_reporting_group_name", "resolution_source", "resolution_state", "resolution_status", "winning_rule_id")
    rows = facts.join(mapping, ["product_id", day], "left").withColumn("mapping_as_of_date", F.col(day))
    mark = fingerprint if isinstance(fingerprint, Column) else F.lit(fingerprint)
    when = refreshed_at if refreshed_at is not None else F.lit(None).cast("timestamp")
    return rows.withColumn("mapping_fingerprint", mark).withColumn("metric_refresh_at", when).select(*S.BRIDGE)


def only_enabled(facts: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Rows of enabled restaurants."""
    return facts.join(restaurants.select("restaurant_id"), "restaurant_id", "left_semi")


def only_excluded(facts: DataFrame, restaurants: DataFrame) -> DataFrame:
    return facts.join(restaurants.select("restaurant_id"), "restaurant_id", "left_anti")
