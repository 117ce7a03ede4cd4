"""The model over the order tables: line items are sales facts, parts products, supplier nations restaurants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.scalar import main_node_id
from mixlens.sources.tables import literal, table

AS_OF = dt.date(2026, 8, 11)

GROUPS = [("RPG-0001", "Add-ons", "Yes", 10), ("RPG-0002", "Non-Alcohol", "Yes", 20), ("RPG-0003", "Spirits/Cocktails", "Yes", 30), ("RPG-0004", "Retired", "No", 40)]
_open, _first = None, dt.date(1899, 12, 31)
RULES = [
    ("MAP-000001", S.MAIN, "SRC-1 || Main || ECONOMY", "RPG-0001", "Map", _first, _open, "Active"),
    ("MAP-000002", S.MAIN, "SRC-1 || Main || LARGE", "RPG-0002", "Map", _first, _open, "Active"),
    ("MAP-000003", S.MAIN, "SRC-1 || Main || MEDIUM", "RPG-0004", "Map", _first, _open, "Active"),
    ("MAP-000004", S.SUB, "SCL-ECONOMY-Brand#1", "RPG-0003", "Map", _first, _open, "Active"),
    ("MAP-000005", S.SUB, "SCL-LARGE-Brand#2", "RPG-0001", "Map", _first, _open, "Active"),
    ("MAP-000006", S.SUB, "SCL-LARGE-Brand#2", "RPG-0003", "Map", dt.date(2025, 12, 9), AS_OF, "Active"),
    ("MAP-000007", S.SUB, "SCL-PROMO-Brand#3", "RPG-0002", "Map", dt.date(2026, 8, 12), _open, "Active"),
    ("MAP-000008", S.MAIN, "SRC-1 || Main || PROMO", "RPG-0003", "Map", _first, dt.date(2026, 8, 10), "Active"),
    ("MAP-000009", S.PRODUCT, "PRD-000001", "", "Exclude", _first, _open, "Active"),
    ("MAP-000010", S.PRODUCT, "PRD-000002", "RPG-0002", "Map", _first, _open, "Active"),
    ("MAP-000011", S.PRODUCT, "PRD-000003", "RPG-0002", "Map", _first, _open, "Inactive"),
    ("MAP-000012", S.MAIN, "SRC-1 || Main || STANDARD", "RPG-0003", "Map", _first, _open, "Active"),
]
EQUIVALENCES = [("LEGACY-EQ-001", "RPG-0001", "CAT-Brand#1", "Equivalent", "Yes"), ("LEGACY-EQ-001", "RPG-0001", "CAT-Brand#2", "Equivalent", "Yes"), ("LEGACY-EQ-002", "RPG-0002", "CAT-Brand#3", "Partial", "Yes"), ("LEGACY-EQ-003", "RPG-0003", "CAT-Brand#4", "Equivalent", "No")]


def groups(spark: SparkSession) -> DataFrame:
    return literal(spark, GROUPS, S.GROUPS)


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, "SRC-1", scope, node, target, action, a, b, status, k) for k, (i, scope, node, target, action, a, b, status) in enumerate(RULES)]
    return literal(spark, rows, S.RULES)


def equivalences(spark: SparkSession) -> DataFrame:
    return literal(spark, EQUIVALENCES, "definition_id string, reporting_group_id string, legacy_category_id string, comparison_status string, active string")


def product_id(key="p_partkey"):
    return F.concat(F.lit("PRD-"), F.lpad(F.col(key).cast("string"), 6, "0"))


def products(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    return part.select(
        product_id().alias("product_id"), F.lit("SRC-1").alias("source_system_id"), F.col("p_name").alias("source_product_name"), F.col("p_brand").alias("sales_account"),
        F.concat(F.lit("SCL-"), "p_type", F.lit("-"), "p_brand").alias("source_classification_id"),
    )


def classifications(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part", ["p_type", "p_brand"]).distinct()
    return part.select(F.concat(F.lit("SCL-"), "p_type", F.lit("-"), "p_brand").alias("source_classification_id"), F.lit("SRC-1").alias("source_system_id"), F.col("p_type").alias("source_main_category"), F.col("p_brand").alias("source_sub_category"))


def restaurants(spark: SparkSession, root: str) -> DataFrame:
    nation = table(spark, root, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return nation.select(restaurant_id("n_nationkey").alias("restaurant_id"), F.col("n_name").alias("source_name"), F.col("n_name").alias("display_name"), F.lit("Active").alias("status"), F.when(F.col("n_regionkey").eqNullSafe(4), "No").otherwise("Yes").alias("reporting_enabled"))


def restaurant_id(key):
    return F.concat(F.lit("RST-"), F.lpad(F.col(key).cast("string"), 2, "0"))


def facts(spark: SparkSession, root: str, dated: bool = False, by_product: bool = False) -> DataFrame:
    """One fact a line item.  Parts, suppliers and nations join as dimensions; orders give the channel.  ``dated``: also
    ``fact_date``, the day it was shipped.  ``by_product``: parts meet line items by product id, all parts of an id in one row, so
    that facts come dealt by ``product_id`` and what joins them by it deals them no more."""
    line = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus"])
    orders = table(spark, root, "orders", ["o_orderkey", "o_orderpriority"])
    supplier = table(spark, root, "supplier", ["s_suppkey", "s_nationkey"])
    part = table(spark, root, "part", ["p_partkey", "p_brand"])
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey, "left").join(supplier, line.l_suppkey == supplier.s_suppkey, "left")
    if by_product:
        held = part.groupBy(product_id().alias("part_id")).agg(F.collect_list(F.struct("p_partkey", "p_brand")).alias("parts"))
        rows = rows.join(held, product_id("l_partkey") == held.part_id, "left")
        rows = rows.select("*", F.explode_outer(F.filter("parts", lambda p: p["p_partkey"] == F.col("l_partkey"))).alias("part")).select("*", "part.p_brand")
    else:
        rows = rows.join(part, line.l_partkey == part.p_partkey, "left")
    day = F.col("l_shipdate").cast("date")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.cast("string")).alias("sales_fact_id"),
        F.concat(F.lit("IMP-"), F.year(day).cast("string")).alias("import_id"),
        F.coalesce(restaurant_id("s_nationkey"), F.lit("")).alias("restaurant_id"),
        product_id("l_partkey").alias("product_id"),
        F.coalesce(F.concat(F.lit("CAT-"), "p_brand"), F.lit("")).alias("legacy_reporting_category_id"),
        F.make_date(F.year(day), F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date(F.year(day), F.lit(12), F.lit(31)).alias("period_end"),
        F.coalesce("o_orderpriority", F.lit("")).alias("reporting_channel"),
        F.col("l_quantity").cast(S.MONEY).alias("quantity"),
        F.col("l_extendedprice").cast(S.MONEY).alias("sales_amount"),
        F.when(F.col("l_linestatus").eqNullSafe("F"), S.ACTIVE_FINALIZED).otherwise("Superseded").alias("publication_state"),
        *([day.alias("fact_date")] if dated else []),
    )


def inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What the model's relations read of the order tables."""
    read = {
        "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus"], "orders": ["o_orderkey", "o_orderpriority"],
        "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_name", "p_type", "p_brand"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    }
    return {name: table(spark, root, name, columns) for name, columns in read.items()}


def imports(spark: SparkSession, root: str) -> DataFrame:
    """One import a shipping year; finalized where any of its line items is."""
    line = table(spark, root, "lineitem", ["l_shipdate", "l_linestatus"])
    by = line.groupBy(F.year(F.col("l_shipdate").cast("date")).alias("y")).agg(F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("f"))
    return by.select(
        F.concat(F.lit("IMP-"), F.col("y").cast("string")).alias("import_id"), F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"),
        F.when(F.col("f") == 1, S.ACTIVE_FINALIZED).otherwise("Superseded").alias("publication_state"), F.lit("Yes").alias("active_version"),
    )


def weekly_imports(spark: SparkSession, root: str) -> DataFrame:
    """One import a shipping week (Monday to Sunday), with the week's number and year."""
    line = table(spark, root, "lineitem", ["l_shipdate", "l_linestatus"])
    start = F.date_trunc("week", F.col("l_shipdate")).cast("date")
    by = line.groupBy(start.alias("period_start")).agg(F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("f"))
    year, week = F.year(F.date_add("period_start", 3)), F.weekofyear("period_start")
    return by.select(
        F.concat(F.lit("IMW-"), year.cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0")).alias("import_id"), "period_start", F.date_add("period_start", 6).alias("period_end"),
        F.when(F.col("f") == 1, S.ACTIVE_FINALIZED).otherwise("Superseded").alias("publication_state"), F.lit("Yes").alias("active_version"), week.alias("reporting_week"), year.alias("reporting_year"),
    )


def categories(spark: SparkSession, root: str) -> DataFrame:
    """One legacy category a brand; the fifth is hidden, the fourth has neither name nor place."""
    brand = table(spark, root, "part", ["p_brand"]).distinct()
    at = F.regexp_extract("p_brand", "(\\d+)$", 1).cast("int")
    return brand.select(F.concat(F.lit("CAT-"), "p_brand").alias("category_id"), F.when(at % 5 == 4, "").otherwise(F.col("p_brand")).alias("category_name"), F.when(at % 5 == 0, "No").otherwise("Yes").alias("visible"), F.when(at % 5 == 4, 0).otherwise(100 - at).alias("sort_order"))
