"""Idempotent migration: decisions that active rules already express are reused, the others become new rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens.functions.scalar import semantic_key
from mixlens.operators.mapping import applicable, rule_errors
from mixlens.operators.sinks import next_ids
from mixlens.operators.validation import error, every
from mixlens.plans.decisions import NOTE
from mixlens.sources.tables import literal

NODE = ["source_system_id", "scope_type", "node_id"]


def decision_errors(rules: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """More than one decision on a node, invalid ones, an active rule that says otherwise, or several that say the same."""
    named = decisions.withColumn("mapping_rule_id", F.col("node_id")).withColumn("effective_from", F.lit(None).cast("date")).withColumn("effective_to", F.lit(None).cast("date"))
    twice = decisions.groupBy(*NODE).count().where("count > 1")
    there = applicable(rules, as_of).select(*NODE, semantic_key().alias("said"))
    met = decisions.select(*NODE, semantic_key().alias("wanted")).join(there, NODE)
    same = met.groupBy(*NODE).agg(F.count(F.when(F.col("said") == F.col("wanted"), 1)).alias("same"), F.count(F.lit(1)).alias("n"))
    return every(
        error(twice, "decision-node", "node_id", "more than one decision"),
        rule_errors(named),
        error(same.where("same = 0"), "decision-conflict", "node_id", "an active rule says otherwise"),
        error(same.where("same > 1"), "decision-repeated", "node_id", "several active rules say the same"),
    )


#: Decisions by kind that the approved contract has: scope type, action, number (fixed values).
CONTRACT = (("SourceMainCategory", "Map", 70), ("SourceSubCategory", "Map", 2), ("Product", "Map", 49), ("Product", "Exclude", 8))


def contract_errors(decisions: DataFrame, groups: DataFrame, nodes: DataFrame, contract=CONTRACT) -> DataFrame:
    """Decisions that are not as approved: two that say the same, other numbers by kind, targets that are missing or not
    active, nodes that are not there."""
    keyed = decisions.select(semantic_key().alias("key"))
    wanted = literal(decisions.sparkSession, list(contract), "scope_type string, rule_action string, wanted bigint")
    have = decisions.groupBy("scope_type", "rule_action").agg(F.count(F.lit(1)).alias("n"))
    other = wanted.join(have, ["scope_type", "rule_action"], "full_outer").where(F.coalesce("n", F.lit(0)) != F.coalesce("wanted", F.lit(0)))
    active = groups.where("active = 'Yes'").select(F.col("reporting_group_id").alias("target_reporting_group_id"))
    return every(
        error(keyed.groupBy("key").count().where("count > 1"), "contract-repeated", "key", "more than one decision says this"),
        error(other, "contract-count", F.concat_ws(" ", "scope_type", "rule_action"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(", expected "), F.coalesce("wanted", F.lit(0)).cast("string"))),
        error(decisions.where("rule_action = 'Map'").join(active, "target_reporting_group_id", "left_anti"), "contract-target", "node_id", "the target is missing or not active"),
        error(decisions.join(nodes.select(*NODE).distinct(), NODE, "left_anti"), "contract-node", "node_id", "no such node"),
    )


def plan(rules: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """``seq, plan, mapping_rule_id`` and the rule of each decision; ``plan`` is reuse or add."""
    there = applicable(rules, as_of).select(semantic_key().alias("key"), "mapping_rule_id").groupBy("key").agg(F.min("mapping_rule_id").alias("mapping_rule_id"))
    met = decisions.withColumn("key", semantic_key()).join(there, "key", "left").drop("key")
    reused = met.where("mapping_rule_id IS NOT NULL").withColumn("plan", F.lit("reuse"))
    added = next_ids(met.where("mapping_rule_id IS NULL"), rules, "mapping_rule_id", "MAP-", ["seq"]).withColumn("plan", F.lit("add"))
    return reused.unionByName(added).select("seq", "plan", "mapping_rule_id", *NODE, "rule_action", "target_reporting_group_id")


def additions(planned: DataFrame, as_of: Column) -> DataFrame:
    """The planned rules as rows of the rule table."""
    new = planned.where("plan = 'add'")
    return new.select("mapping_rule_id", *NODE, "target_reporting_group_id", "rule_action", as_of.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("Active").alias("status"), "seq", F.lit(NOTE).alias("notes"))
