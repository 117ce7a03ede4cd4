"""Groups and dated rules that are derived from the order tables, so that they grow with them.

* A group a brand; every sixth is inactive.
* Main categories: a rule for each of the first three quarters of a year in which something was shipped, none for the fourth.
* Subcategories of even brands: a rule a year, from its first shipment to forty days after its last, so years overlap.
* Every third product: a rule a return flag, for 400 days from its first shipment, open for every fifth product; every 21st
  product is excluded; rules of every 33rd are inactive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.scalar import main_node_id
from mixlens.sources import binding
from mixlens.sources.tables import table

BRANDS = 25


def _number(brand) -> Column:
    return F.regexp_extract(brand, "(\\d+)$", 1).cast("int")


def _group(number: Column) -> Column:
    return F.concat(F.lit("GRP-"), F.lpad(number.cast("string"), 3, "0"))


def groups(spark: SparkSession, root: str) -> DataFrame:
    k = _number("p_brand")
    brand = table(spark, root, "part", ["p_brand"]).distinct()
    return brand.select(_group(k).alias("reporting_group_id"), F.col("p_brand").alias("reporting_group_name"), F.when(k % 6 == 0, "No").otherwise("Yes").alias("active"), (k * 10).alias("sort_order"))


def rules(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part", ["p_partkey", "p_type", "p_brand"])
    line = table(spark, root, "lineitem", ["l_partkey", "l_shipdate", "l_returnflag"]).withColumn("day", F.col("l_shipdate").cast("date"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    key, no_end = F.col("l_partkey"), F.lit(None).cast("date")
    out = key % 21 == 0
    product = line.where(key % 3 == 0).groupBy("l_partkey", "l_returnflag").agg(F.min("day").alias("f"))
    product = product.select(
        F.concat(F.lit("RUL-P-"), F.lpad(key.cast("string"), 9, "0"), F.lit("-"), "l_returnflag").alias("mapping_rule_id"), F.lit(S.PRODUCT).alias("scope_type"), binding.product_id("l_partkey").alias("node_id"),
        F.when(out, "").otherwise(_group((F.ascii("l_returnflag") + key) % BRANDS + 1)).alias("target_reporting_group_id"), F.when(out, "Exclude").otherwise("Map").alias("rule_action"),
        "f", F.when(key % 5 == 0, no_end).otherwise(F.date_add("f", 400)).alias("t"), F.when(key % 33 == 0, "Inactive").otherwise("Active").alias("status"),
    )
    year = F.year("day").alias("y")
    sub = rows.where(_number("p_brand") % 2 == 0).groupBy("p_type", "p_brand", year).agg(F.min("day").alias("f"), F.date_add(F.max("day"), 40).alias("t"))
    sub = sub.select(
        F.concat_ws("-", F.lit("RUL-S"), "p_type", "p_brand", F.col("y").cast("string")).alias("mapping_rule_id"), F.lit(S.SUB).alias("scope_type"), F.concat(F.lit("SCL-"), "p_type", F.lit("-"), "p_brand").alias("node_id"),
        _group(_number("p_brand")).alias("target_reporting_group_id"), F.lit("Map").alias("rule_action"), "f", "t", F.lit("Active").alias("status"),
    )
    main = rows.groupBy("p_type", F.trunc("day", "quarter").alias("f")).agg(F.lit(1).alias("one")).where(F.quarter("f") < 4)
    main = main.select(
        F.concat_ws("-", F.lit("RUL-M"), "p_type", F.year("f").cast("string"), F.quarter("f").cast("string")).alias("mapping_rule_id"), F.lit(S.MAIN).alias("scope_type"), main_node_id(F.lit("SRC-1"), "p_type").alias("node_id"),
        _group((F.length("p_type") + F.quarter("f")) % BRANDS + 1).alias("target_reporting_group_id"), F.lit("Map").alias("rule_action"), "f", F.date_sub(F.add_months("f", 3), 1).alias("t"), F.lit("Active").alias("status"),
    )
    every = reduce(DataFrame.unionByName, (product, sub, main))
    return every.select("mapping_rule_id", F.lit("SRC-1").alias("source_system_id"), "scope_type", "node_id", "target_reporting_group_id", "rule_action", F.col("f").alias("effective_from"), F.col("t").alias("effective_to"), "status", F.lit(0).alias("seq"))


def faulty_rules(spark: SparkSession, root: str) -> DataFrame:
    """The same with faults, a kind for each residue of the product (or, for others, the year's last digit)."""
    k = F.regexp_extract("mapping_rule_id", "([0-9])[^0-9]*$", 1).cast("int")
    rows = rules(spark, root).withColumn("k", k)
    change = {
        "rule_action": F.when(F.col("k") == 1, "Keep").when((F.col("k") == 2) & (F.col("scope_type") == S.SUB), "Exclude"),
        "scope_type": F.when(F.col("k") == 3, "Brand"),
        "target_reporting_group_id": F.when(F.col("k") == 4, ""),
        "effective_to": F.when(F.col("k") == 5, F.date_sub("effective_from", 1)),
    }
    return rows.select(*(F.coalesce(change[c], c).alias(c) if c in change else F.col(c) for c in rows.columns)).drop("k")
