"""Editing rules: a new one is validated, numbered and added; an old one is made inactive; each edit leaves a log line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.operators import mapping, sinks, validation


def add_rule(rules: DataFrame, nodes: DataFrame, groups: DataFrame, source: str, scope: str, node: str, target: str, start: Column, end: Column | None = None, action: str = "Map") -> DataFrame:
    """The rules with one more, active from ``start``; raises if it may not be authored."""
    spark = rules.sparkSession
    row = spark.range(1).select(
        F.lit("").alias("mapping_rule_id"), F.lit(source).alias("source_system_id"), F.lit(scope).alias("scope_type"), F.lit(node).alias("node_id"), F.lit(target).alias("target_reporting_group_id"),
        F.lit(action).alias("rule_action"), start.alias("effective_from"), (end if end is not None else F.lit(None)).cast("date").alias("effective_to"), F.lit("Active").alias("status"),
        F.lit(0).alias("seq"),
    )
    new = sinks.next_ids(row, rules, "mapping_rule_id", "MAP-", ["node_id"])
    validation.raise_if_any(validation.authoring_errors(rules, new, validation.node_catalogue(nodes), groups))
    last = rules.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    return rules.unionByName(new.crossJoin(last).withColumn("seq", (F.col("last") + 1).cast("int")).select(*rules.columns))


def end_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return mapping.deactivate(rules, rule_id)


def log_line(log: DataFrame, action: str, status: str, area: str, detail: str, build: str = "") -> DataFrame:
    """One row for the build log, with the next id."""
    row = log.sparkSession.range(1).select(F.lit("").alias("log_id"), F.current_timestamp().alias("logged_at"), F.lit(build).alias("build"), F.lit(action).alias("action"), F.lit(status).alias("status"), F.lit(area).alias("area"), F.lit(detail).alias("detail"))
    return sinks.next_ids(row, log, "log_id", "LOG-", ["action"])
