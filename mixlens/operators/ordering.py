"""Orders of the reports.  Facts are never sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.operators.aggregates import SCOPE
from mixlens.sources import scratch

GROUP_TOTALS = (*SCOPE, "reporting_group_id")
IMPORTS = ("period_start", "period_end", "import_id")
GROUPS = ("sort_order", "reporting_group_name", "reporting_group_id")
RESTAURANTS = ("restaurant_name", "restaurant_id")
CROSSWALK = (*SCOPE, "legacy_reporting_category_id", "effective_reporting_group_id", "resolution_status")
COMPARISON = ("definition_id", *SCOPE)
MAIN_BROWSE = ("source_main_category", "node_id")
SUB_BROWSE = ("source_main_category", "source_sub_category", "node_id")
CATEGORIES = ("sort_order", "category_name", "category_id")


#: Columns of names, which are ordered as a language orders them; ids and codes go by their bytes.
NAMES = {"restaurant_name", "reporting_group_name", "category_name"}
#: The root collation; any of Spark's, such as ``nb`` for Norwegian, may be given instead.
COLLATION = "UNICODE"


def _keys(keys: tuple[str | Column, ...], collation: str) -> list[Column]:
    return [F.collate(F.col(k), collation) if isinstance(k, str) and k in NAMES else F.col(k) if isinstance(k, str) else k for k in keys]


def arranged(df: DataFrame, keys: tuple[str | Column, ...], collation: str = COLLATION) -> DataFrame:
    return df.orderBy(*_keys(keys, collation))


def numbered(df: DataFrame, keys: tuple[str | Column, ...], collation: str = COLLATION) -> DataFrame:
    """A report with ``position``, from 1.  Rows are dealt in ranges of their order and written; each range is numbered by itself, from
    the number of rows in those before it, so no task sees the whole report."""
    spark, order, path = df.sparkSession, _keys(keys, collation), scratch.folder(df.sparkSession, "ordered")
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return rows.withColumn("position", place.cast("int")).drop("_part", "_before")


def results(df: DataFrame, imports: DataFrame, groups: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Share results with ``position``: by import, group, the company before its restaurants, and restaurant."""
    rows = df.join(imports.select("import_id", "period_start", "period_end"), "import_id").join(groups.select("reporting_group_id", "sort_order"), "reporting_group_id")
    rows = rows.join(restaurants.select("restaurant_id", "restaurant_name"), "restaurant_id", "left")
    keys = (*IMPORTS, *GROUPS, "scope_type", *RESTAURANTS)
    return numbered(rows, keys).select("position", *df.columns)
