"""Names, closed sets and column lists of the model."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed sets (fixed values).
MAPPED, UNMAPPED, CONFLICT, INACTIVE = "Mapped", "Unmapped", "Conflict", "Inactive Target"
MAPPING_STATES = (MAPPED, UNMAPPED, CONFLICT, INACTIVE)
RESOLUTION_STATES = ("Explicit", "Inherited", "Explicit exclusion", "Explicit conflict", "Unmapped")
COMPARISONS = ("Equivalent", "Partial", "Not Comparable")
ACTIVE_FINALIZED = "Active Finalized"
ALL_FACTS, ALL_IMPORTS, ALL_CHANNELS = "All facts", "All imports", "All channels"
MAIN, SUB, PRODUCT = "SourceMainCategory", "SourceSubCategory", "Product"
#: (scope type, level), ascending specificity; a parameter wherever it is used.
HIERARCHY = ((MAIN, 1), (SUB, 2), (PRODUCT, 3))
#: Kind of metric the share results belong to.
SHARE_METRIC = "KPI-0001"

MONEY, TOTAL = T.DecimalType(18, 2), T.DecimalType(38, 2)

FACTS = (
    "sales_fact_id import_id restaurant_id product_id legacy_reporting_category_id period_start period_end "
    "reporting_channel quantity sales_amount publication_state"
).split()
EFFECTIVE = (
    "product_id source_system_id source_product_name sales_account source_main_category source_sub_category "
    "source_classification_id main_category_rule_id main_category_target_id subcategory_rule_id subcategory_target_id "
    "product_rule_id product_target_id effective_reporting_group_id effective_reporting_group_name resolution_source "
    "resolution_state resolution_status winning_rule_id main_node_id subcategory_node_id as_of_date"
).split()
BRIDGE = (
    "sales_fact_id import_id restaurant_id product_id reporting_channel period_start period_end publication_state quantity "
    "sales_amount legacy_reporting_category_id effective_reporting_group_id effective_reporting_group_name resolution_source "
    "resolution_state resolution_status winning_rule_id mapping_as_of_date mapping_fingerprint metric_refresh_at"
).split()

RESULTS = (
    "metric_id import_id scope_type restaurant_id reporting_group_id reporting_group_name numerator denominator metric_value "
    "restaurant_scope_fingerprint metric_result_id calculated_at mapping_fingerprint mapping_as_of_date"
).split()

RULES = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in "mapping_rule_id source_system_id scope_type node_id target_reporting_group_id rule_action".split()),
        T.StructField("effective_from", T.DateType()),
        T.StructField("effective_to", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("seq", T.IntegerType()),
    ]
)
GROUPS = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("reporting_group_id", "reporting_group_name", "active")),
        T.StructField("sort_order", T.IntegerType()),
    ]
)
