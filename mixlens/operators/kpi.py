"""Share-of-sales results for the company and each restaurant, and what reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.fingerprint import metric_result_id, restaurant_scope_fingerprint
from mixlens.functions.scalar import share
from mixlens.sources.tables import literal

COMPANY, RESTAURANT, ALL_RESTAURANTS = "Company", "Restaurant", "All restaurants"


def share_results(
    bridge: DataFrame,
    imports: DataFrame,
    groups: DataFrame,
    restaurants: DataFrame,
    measure: str = "sales_amount",
    metric: str = S.SHARE_METRIC,
    calculated_at: Column | None = None,
    identify: bool = True,
) -> DataFrame:
    """Every import x active group x (company, each enabled restaurant): a group's mapped sum over the sum of all states.

    One scan and one aggregation by (import, restaurant, group) with partial sums; the company's rows and both sums are
    rolled up from that small cube once (the groups of a scope as a map), and the dense grid is a product of dimensions
    alone.  A row of a bridge that holds ``copies`` counts so often."""
    enabled = restaurants.select("restaurant_id")
    kept = bridge.where(F.col("publication_state") == S.ACTIVE_FINALIZED).join(imports.select("import_id"), "import_id", "left_semi").join(enabled, "restaurant_id", "left_semi")
    group = F.when(F.col("resolution_status") == S.MAPPED, F.col("effective_reporting_group_id"))
    value = F.col(measure) * F.col("copies") if "copies" in bridge.columns else F.col(measure)
    cube = kept.groupBy("import_id", "restaurant_id", group.alias("g")).agg(F.sum(value).alias("s"))
    scope = F.explode(F.array(F.struct(F.lit(COMPANY).alias("scope_type"), F.lit("").alias("restaurant_id")), F.struct(F.lit(RESTAURANT).alias("scope_type"), F.col("restaurant_id").alias("restaurant_id"))))
    rolled = cube.select("import_id", "g", "s", scope.alias("x")).groupBy("import_id", "x.scope_type", "x.restaurant_id", "g").agg(F.sum("s").alias("s"))
    keys = ["import_id", "scope_type", "restaurant_id"]
    held = F.collect_list(F.when(F.col("g").isNotNull(), F.struct("g", "s")))
    sums = rolled.groupBy(*keys).agg(F.sum("s").alias("d"), F.map_from_entries(held).alias("by_group"))
    active = groups.where("active = 'Yes'").select("reporting_group_id", "reporting_group_name")
    company = restaurants.sparkSession.range(1).select(F.lit(COMPANY).alias("scope_type"), F.lit("").alias("restaurant_id"))
    places = company.unionByName(enabled.select(F.lit(RESTAURANT).alias("scope_type"), "restaurant_id"))
    grid = imports.select("import_id").crossJoin(active).crossJoin(places)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(S.TOTAL)
    rows = grid.join(sums, keys, "left").withColumn("n", F.col("by_group")[F.col("reporting_group_id")])
    rows = rows.select(F.lit(metric).alias("metric_id"), *keys, "reporting_group_id", "reporting_group_name", zero(F.col("n")).alias("numerator"), zero(F.col("d")).alias("denominator"), share("n", "d").alias("metric_value"))
    if not identify:
        return rows
    rows = rows.crossJoin(F.broadcast(restaurant_scope_fingerprint(restaurants)))
    return rows.withColumn("metric_result_id", metric_result_id(F.col("restaurant_scope_fingerprint"))).withColumn("calculated_at", calculated_at if calculated_at is not None else F.lit(None).cast("timestamp"))


def defaults(imports: DataFrame) -> DataFrame:
    """One row: the latest import, and the one before (the latest again, if it is the only one)."""
    place = F.struct("period_start", "period_end", "import_id")
    two = imports.select(place.alias("p")).orderBy(F.desc("p")).limit(2)
    return two.agg(F.max("p")["import_id"].alias("current_import"), F.min("p")["import_id"].alias("comparison_import"))


def id_of(df: DataFrame, label: Column, name: str, key: str) -> Column:
    """A scalar: the ``key`` of the row whose ``name`` is the label; null if there is none, an error if there are several."""
    found = df.where(F.col(name) == label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("k"))
    return found.select(F.when(F.col("n") > 1, F.raise_error(F.lit(f"several rows have one {name}")).cast("string")).otherwise(F.col("k"))).scalar()


def selection(imports: DataFrame, groups: DataFrame, current: str = "", compared: str = "", group: str = "") -> DataFrame:
    """One row, the selectors' state: labels chosen before are kept as long as they name something active, else the
    defaults are taken (the latest import, the one before, the first group)."""
    active = groups.where("active = 'Yes'")
    first = active.agg(F.min(F.struct("sort_order", "reporting_group_name", "reporting_group_id"))["reporting_group_id"].alias("first"))
    chosen = defaults(imports).crossJoin(first)
    pick = lambda df, label, name, key, other: F.coalesce(id_of(df, F.lit(label), name, key), F.col(other))
    return chosen.select(
        pick(imports, current, "label", "import_id", "current_import").alias("current_import"),
        pick(imports, compared, "label", "import_id", "comparison_import").alias("comparison_import"),
        pick(active, group, "reporting_group_name", "reporting_group_id", "first").alias("reporting_group_id"),
    )


def lookup(results: DataFrame, **key: str) -> DataFrame:
    """Results whose columns equal the values given."""
    for name, value in key.items():
        results = results.where(F.col(name) == value)
    return results


def comparison(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each group and scope under the current and the comparison import, with the change."""
    both = results.join(F.broadcast(chosen), (F.col("import_id") == F.col("current_import")) | (F.col("import_id") == F.col("comparison_import")))
    now, then = F.col("import_id") == F.col("current_import"), F.col("import_id") == F.col("comparison_import")
    keys = ["current_import", "comparison_import", "scope_type", "restaurant_id", "reporting_group_id", "reporting_group_name"]
    rows = both.groupBy(*keys).agg(
        F.max(F.when(now, F.col("metric_value"))).alias("current_share"), F.max(F.when(then, F.col("metric_value"))).alias("comparison_share"),
        F.max(F.when(now, F.col("numerator"))).alias("current_sales"), F.max(F.when(then, F.col("numerator"))).alias("comparison_sales"),
    )
    return rows.withColumn("change", F.col("current_share") - F.col("comparison_share"))


def comparison_check(imports: DataFrame, chosen: DataFrame) -> DataFrame:
    """Whether the two chosen datasets have one length, and are one."""
    by = imports.select("import_id", "label", "days")
    a, b = by.toDF("current_import", "current_label", "current_days"), by.toDF("comparison_import", "comparison_label", "comparison_days")
    rows = chosen.join(a, "current_import").join(b, "comparison_import")
    same, equal = F.col("current_import") == F.col("comparison_import"), F.col("current_days") == F.col("comparison_days")
    return rows.withColumn("period_length", F.when(equal, "Same").otherwise("Different")).withColumn("same_dataset", F.when(same, "Yes").otherwise("No")).withColumn("status", F.when(same, "Same dataset selected").when(~equal, "Different period lengths").otherwise("Comparable"))


def overview(imports: DataFrame, results: DataFrame) -> DataFrame:
    """One row: the latest dataset, how many there are, and its company sales."""
    latest = defaults(imports).select(F.col("current_import").alias("import_id")).join(imports, "import_id").select("import_id", "label", "period_start", "period_end")
    many = imports.agg(F.count(F.lit(1)).alias("active_imports"))
    total = results.where(F.col("scope_type") == COMPANY).groupBy("import_id").agg(F.max("denominator").alias("company_sales"))
    return latest.crossJoin(many).join(total, "import_id", "left")


def category_share(facts: DataFrame, by_restaurant: bool = False) -> DataFrame:
    """Legacy category over all, by import and channel [and restaurant], finalized facts; and for all channels."""
    keys = ["import_id", "channel", *(["restaurant_id"] if by_restaurant else [])]
    rows = facts.where(F.col("publication_state") == S.ACTIVE_FINALIZED)
    cube = rows.groupBy("import_id", F.col("reporting_channel").alias("c"), *keys[2:], "legacy_reporting_category_id").agg(F.sum("sales_amount").alias("s"))
    cube = cube.withColumn("channel", F.explode(F.array(F.lit(S.ALL_CHANNELS), F.col("c")))).where("channel <> ''")
    part = cube.groupBy(*keys, "legacy_reporting_category_id").agg(F.sum("s").cast(S.TOTAL).alias("category_sales"))
    whole = cube.groupBy(*keys).agg(F.sum("s").cast(S.TOTAL).alias("all_sales"))
    return part.join(whole, keys).withColumn("category_share", share("category_sales", "all_sales"))


#: id, name, kind, numerator, denominator, scopes, membership, status (fixed values).
METRICS = (
    ("MEASURE-SALES-NOK", "Sales NOK", "Currency", "SUM(SalesAmount)", "", "Import, Channel, Restaurant", "All states", "Active"),
    ("MEASURE-QUANTITY", "Quantity", "Number", "SUM(Quantity)", "", "Import, Channel, Restaurant", "All states", "Active"),
    ("MEASURE-FACT-COUNT", "Fact count", "Number", "COUNT(SalesFactID)", "", "Import, Channel, Restaurant", "All states", "Active"),
    (S.SHARE_METRIC, "Reporting Group Sales Share", "Ratio", "Mapped sales of the group", "Sales of all states", "Import, Company, Restaurant", "Mapped", "Active"),
    ("KPI-QUANTITY-SHARE", "Reporting Group Quantity Share", "Ratio", "Mapped quantity of the group", "Quantity of all states", "Import, Company, Restaurant", "Mapped", "Draft"),
)


def metric_contract(spark) -> DataFrame:
    names = "metric_id display_name value_type numerator denominator scope_dimensions mapping_membership status".split()
    return literal(spark, list(METRICS), ", ".join(f"{n} string" for n in names))
