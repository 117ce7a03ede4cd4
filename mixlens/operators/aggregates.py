"""Scopes and the aggregates over them.

A fact belongs to at most three scopes (all facts; its import if finalized; its import and channel).  Facts are summed once
by state, import, channel and the wanted keys; only the rows of that small cube are expanded to their scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens import schema as S

SCOPE = ["publication_scope", "import_id", "channel_scope"]


def measures(prefix: str = "", only: Column | None = None, times: Column | None = None) -> list[Column]:
    """Count, sales and quantity, 0 over no rows; each row counts ``times``, if given."""
    pick = (lambda c: F.when(only, c)) if only is not None else (lambda c: c)
    if times is not None:
        total = lambda c: F.coalesce(F.sum(pick(c * times)), F.lit(0))
        return [total(F.lit(1)).alias(f"{prefix}fact_count"), *(total(F.col(c)).cast(S.TOTAL).alias(f"{prefix}{name}") for c, name in (("sales_amount", "sales_nok"), ("quantity", "quantity")))]
    return [
        F.count(pick(F.lit(1))).alias(f"{prefix}fact_count"),
        F.coalesce(F.sum(pick(F.col("sales_amount"))), F.lit(0)).cast(S.TOTAL).alias(f"{prefix}sales_nok"),
        F.coalesce(F.sum(pick(F.col("quantity"))), F.lit(0)).cast(S.TOTAL).alias(f"{prefix}quantity"),
    ]


def totals(df: DataFrame) -> DataFrame:
    return df.agg(*measures())


def scopes(facts: DataFrame) -> DataFrame:
    """The scopes there are: all facts, each finalized import, each of its channels that isn't blank."""
    keys = facts.where(F.col("publication_state") == S.ACTIVE_FINALIZED).select("import_id", "reporting_channel").distinct()
    spark = facts.sparkSession
    every = spark.range(1).select(F.lit(S.ALL_FACTS).alias(SCOPE[0]), F.lit(S.ALL_IMPORTS).alias(SCOPE[1]), F.lit(S.ALL_CHANNELS).alias(SCOPE[2]))
    one = keys.select(F.lit(S.ACTIVE_FINALIZED).alias(SCOPE[0]), "import_id", F.lit(S.ALL_CHANNELS).alias(SCOPE[2])).distinct()
    two = keys.where("reporting_channel <> ''").select(F.lit(S.ACTIVE_FINALIZED).alias(SCOPE[0]), "import_id", F.col("reporting_channel").alias(SCOPE[2]))
    return every.unionByName(one).unionByName(two)


def in_scope(df: DataFrame, publication: str = "", import_id: str = "", channel: str = "", restaurant: str = "") -> DataFrame:
    """Rows of one scope; an empty or ``All ...`` value is any."""
    for column, value in (("publication_state", publication), ("import_id", import_id), ("reporting_channel", channel), ("restaurant_id", restaurant)):
        if value and not value.startswith("All "):
            df = df.where(F.col(column) == value)
    return df


def expand_scopes(df: DataFrame) -> DataFrame:
    """Each row once for every scope that holds it, with the scope's keys."""
    final = F.col("publication_state") == S.ACTIVE_FINALIZED
    key = lambda p, i, c: F.struct(p.alias(SCOPE[0]), i.alias("scope_import"), c.alias(SCOPE[2]))
    keys = F.array(
        key(F.lit(S.ALL_FACTS), F.lit(S.ALL_IMPORTS), F.lit(S.ALL_CHANNELS)),
        F.when(final, key(F.lit(S.ACTIVE_FINALIZED), F.col("import_id"), F.lit(S.ALL_CHANNELS))),
        F.when(final & (F.col("reporting_channel") != ""), key(F.lit(S.ACTIVE_FINALIZED), F.col("import_id"), F.col("reporting_channel"))),
    )
    rows = df.withColumn("s", F.explode(F.filter(keys, lambda k: k.isNotNull())))
    return rows.withColumn("publication_scope", F.col("s.publication_scope")).withColumn("import_id", F.col("s.scope_import")).withColumn("channel_scope", F.col("s.channel_scope")).drop("s")


def by_scope(df: DataFrame, *keys: str) -> DataFrame:
    """Count, sales and quantity by scope and keys."""
    cube = df.groupBy("publication_state", "import_id", "reporting_channel", *keys).agg(*measures())
    total = [F.sum("fact_count").alias("fact_count"), *(F.sum(m).cast(S.TOTAL).alias(m) for m in ("sales_nok", "quantity"))]
    return expand_scopes(cube).groupBy(*SCOPE, *keys).agg(*total)


def group_totals(bridge: DataFrame, by_scopes: bool = True) -> DataFrame:
    """Mapped facts by group (and scope)."""
    rows = bridge.where(F.col("resolution_status") == S.MAPPED).withColumnsRenamed({"effective_reporting_group_id": "reporting_group_id", "effective_reporting_group_name": "reporting_group_name"})
    keys = ["reporting_group_id", "reporting_group_name"]
    return by_scope(rows, *keys) if by_scopes else rows.groupBy(*keys).agg(*measures())


def crosswalk(bridge: DataFrame) -> DataFrame:
    """Scope by legacy category, group and state."""
    return by_scope(bridge, "legacy_reporting_category_id", "effective_reporting_group_id", "effective_reporting_group_name", "resolution_status")


def state_coverage(bridge: DataFrame) -> DataFrame:
    """Every scope and state, also those without a fact; an unknown state is an error."""
    known = F.when(F.col("resolution_status").isin(*S.MAPPING_STATES), F.col("resolution_status")).otherwise(F.raise_error(F.concat(F.lit("unknown mapping state "), F.coalesce("resolution_status", F.lit("null")))).cast("string"))
    names = ("fact_count", "sales_nok", "quantity")
    by = by_scope(bridge.withColumn("resolution_status", known), "resolution_status").groupBy(*SCOPE).pivot("resolution_status", list(S.MAPPING_STATES)).agg(*(F.sum(m).alias(m) for m in names))
    zero = lambda s, m: F.coalesce(F.col(f"`{s}_{m}`"), F.lit(0)).cast("bigint" if m == "fact_count" else S.TOTAL).alias(m)
    each = F.array(*(F.struct(F.lit(s).alias("resolution_status"), *(zero(s, m) for m in names)) for s in S.MAPPING_STATES))
    return by.select(*SCOPE, F.explode(each).alias("e")).select(*SCOPE, "e.*")


def reconciliation(facts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per scope: source against bridge against the sum over states; exact decimals, so equality is exact."""
    short = {S.MAPPED: "mapped", S.UNMAPPED: "unmapped", S.CONFLICT: "conflict", S.INACTIVE: "inactive"}
    kinds = ("fact_count", "sales_nok", "quantity")
    typed = lambda c, k: F.coalesce(c, F.lit(0)).cast("bigint" if k == "fact_count" else S.TOTAL)
    source = by_scope(facts).withColumnsRenamed({k: f"source_{k}" for k in kinds})
    made = by_scope(bridge, "resolution_status").groupBy(*SCOPE).agg(
        *(F.sum(k).alias(f"bridge_{k}") for k in kinds),
        *(F.sum(F.when(F.col("resolution_status") == s, F.col(k))).alias(f"{p}_{k}") for s, p in short.items() for k in kinds),
    )
    both = source.join(made, SCOPE, "full_outer")
    both = both.select(*SCOPE, *(typed(F.col(f"{p}_{k}"), k).alias(f"{p}_{k}") for p in ("source", "bridge", *short.values()) for k in kinds))
    both = both.select("*", *((F.col(f"bridge_{k}") - F.col(f"source_{k}")).alias(f"variance_{k}") for k in kinds), *((sum((F.col(f"{p}_{k}") for p in short.values()), F.lit(0)) - F.col(f"bridge_{k}")).alias(f"state_variance_{k}") for k in kinds))
    ok = sum((F.abs(F.col(f"{v}_{k}")) for v in ("variance", "state_variance") for k in kinds), F.lit(0)) == 0
    return both.withColumn("result", F.when(ok, "PASS").otherwise("FAIL"))


def legacy_comparison(bridge: DataFrame, definitions: DataFrame) -> DataFrame:
    """Active definitions by scope: legacy categories against the group, variances (group less legacy) and shares.  One
    small cube of the facts meets the definitions on equal keys; only scopes and definitions, both few, are paired."""
    names = ("fact_count", "sales_nok", "quantity")
    cube = by_scope(bridge, "legacy_reporting_category_id", "effective_reporting_group_id", "resolution_status")
    own = ["definition_id", "comparison_status", "reporting_group_id"]
    wanted = definitions.where("active = 'Yes'").select(*own, "legacy_category_id").distinct()
    act = wanted.groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set("legacy_category_id")), ", ").alias("legacy_category_ids"))
    total = lambda df, p, *keys: df.groupBy(*keys, *SCOPE).agg(*(F.sum(m).alias(f"{p}_{m}") for m in names))
    legacy = total(cube.join(wanted, cube.legacy_reporting_category_id == wanted.legacy_category_id), "legacy", *own)
    mapped = cube.where(F.col("resolution_status") == S.MAPPED).withColumnRenamed("effective_reporting_group_id", "reporting_group_id")
    group = total(mapped.join(act, "reporting_group_id"), "group", *own)
    rows = total(cube, "scope").crossJoin(act).join(legacy, [*own, *SCOPE], "left").join(group, [*own, *SCOPE], "left")
    zero = lambda p, m: F.coalesce(F.col(f"{p}_{m}"), F.lit(0)).cast("bigint" if m == "fact_count" else S.TOTAL).alias(f"{p}_{m}")
    rows = rows.select("definition_id", "comparison_status", *SCOPE, "reporting_group_id", "legacy_category_ids", *(zero(p, m) for p in ("scope", "legacy", "group") for m in names))
    from mixlens.functions.scalar import share

    rows = rows.select("*", *((F.col(f"group_{m}") - F.col(f"legacy_{m}")).alias(f"variance_{m}") for m in ("fact_count", "sales_nok", "quantity")), share("legacy_sales_nok", "scope_sales_nok").alias("legacy_share"), share("group_sales_nok", "scope_sales_nok").alias("group_share"))
    same = (F.col("variance_fact_count") == 0) & (F.col("variance_sales_nok") == 0) & (F.col("variance_quantity") == 0)
    return rows.withColumn("variance_share", F.col("group_share") - F.col("legacy_share")).withColumn("result", F.when(F.col("comparison_status") != "Equivalent", "INFO").when(same, "PASS").otherwise("VARIANCE"))


def enabled_split(facts: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Enabled, excluded and complete measures, by one conditional aggregate."""
    marked = facts.join(restaurants.select("restaurant_id", F.lit(True).alias("on")), "restaurant_id", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    return marked.agg(*measures("enabled_", F.col("on")), *measures("excluded_", ~F.col("on")), *measures("complete_"))


def sales_context(facts: DataFrame) -> DataFrame:
    """Finalized sales by product."""
    rows = facts.where((F.col("publication_state") == S.ACTIVE_FINALIZED) & (F.col("product_id") != ""))
    return rows.groupBy("product_id").agg(F.sum("sales_amount").cast(S.TOTAL).alias("sales_nok"), F.sum("quantity").cast(S.TOTAL).alias("quantity"))


def browse(effective: DataFrame, facts: DataFrame, level: str = "main") -> DataFrame:
    """Nodes of a level with their rules, products, sales and exceptions; or the products themselves."""
    rows = effective.join(sales_context(facts), "product_id", "left").withColumn("sales_nok", F.coalesce("sales_nok", F.lit(0)).cast(S.TOTAL)).withColumn("quantity", F.coalesce("quantity", F.lit(0)).cast(S.TOTAL))
    if level == "product":
        return rows.select("source_system_id", F.lit(S.PRODUCT).alias("scope_type"), F.col("product_id").alias("node_id"), "source_main_category", "source_sub_category", F.col("source_product_name").alias("product"), "sales_account", "sales_nok", "quantity", "effective_reporting_group_name", "resolution_source", "resolution_state", "resolution_status", "winning_rule_id")
    main = level == "main"
    scope, own = (S.MAIN, "main_category") if main else (S.SUB, "subcategory")
    keys = ["source_system_id", F.lit(scope).alias("scope_type"), F.col("main_node_id" if main else "subcategory_node_id").alias("node_id"), "source_main_category", *([] if main else ["source_sub_category"])]
    below = [S.SUB, S.PRODUCT] if main else [S.PRODUCT]
    return rows.groupBy(*keys).agg(
        F.max(f"{own}_rule_id").alias("explicit_rules"), F.max(f"{own}_target_id").alias("target_group_ids"),
        *([F.countDistinct("subcategory_node_id").alias("subcategories")] if main else []),
        F.countDistinct("product_id").alias("products"),
        F.count(F.when((F.col("resolution_source") == scope) & (F.col("resolution_status") != S.CONFLICT), 1)).alias("inheriting_products"),
        F.sum("sales_nok").cast(S.TOTAL).alias("sales_nok"), F.sum("quantity").cast(S.TOTAL).alias("quantity"),
        F.count(F.when(F.col("resolution_source").isin(*below), 1)).alias("descendant_exceptions"),
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
