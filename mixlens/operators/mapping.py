"""Rule resolution: which group each product belongs to on a day, by the most specific rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.scalar import hierarchy_level, id_list, in_effect, main_node_id
from mixlens.operators import intervals
from mixlens.sources import scratch

#: Column of a product that holds its node at each scope type.
NODES = {S.MAIN: "main_node_id", S.SUB: "source_classification_id", S.PRODUCT: "product_id"}
#: What a rule is about, and what it says.
NODE, RULE = ["source_system_id", "scope_type", "node_id"], ["mapping_rule_id", "target_reporting_group_id", "rule_action"]
#: What is decided of a product.
DECISION = ["effective_reporting_group_id", "effective_reporting_group_name", "resolution_source", "resolution_state", "resolution_status", "winning_rule_id"]
LINEAGE = {S.MAIN: "main_category", S.SUB: "subcategory", S.PRODUCT: "product"}


def levels(hierarchy) -> list[tuple[str, int, str, str]]:
    """(scope type, level, node column, lineage name), least specific first.  The known scope types need no more than their
    level; any other brings the column that holds its nodes, and the name of its lineage columns."""
    out = []
    for scope, level, *rest in hierarchy:
        if not rest and scope not in NODES:
            raise ValueError(f"scope type {scope} needs its node column and lineage name")
        node, name = rest or (NODES[scope], LINEAGE[scope])
        out.append((scope, level, node, name))
    return sorted(out, key=lambda x: x[1])


def product_hierarchy(products: DataFrame, classifications: DataFrame) -> DataFrame:
    """Products with their classification's categories and nodes; one without a classification keeps blanks, which
    ``validation.hierarchy_errors`` reports."""
    cls = classifications.select("source_classification_id", F.col("source_system_id").alias("cls_source"), "source_main_category", "source_sub_category")
    both = products.join(cls, "source_classification_id", "left")
    return both.select(
        "product_id", "source_system_id", "source_product_name", "sales_account", F.coalesce("source_main_category", F.lit("")).alias("source_main_category"),
        F.coalesce("source_sub_category", F.lit("")).alias("source_sub_category"), "source_classification_id",
        F.coalesce(main_node_id("cls_source", "source_main_category"), F.lit("")).alias("main_node_id"),
    )


def applicable(rules: DataFrame, as_of: Column) -> DataFrame:
    return rules.where((F.col("status") == "Active") & in_effect(as_of))


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of active rules on one node whose intervals overlap, in input order (``seq``, then id).  A sweep leaves the rules that
    overlap some other; those meet by buckets of days, so a node with many rules costs what its pairs do.  A rule that ends before
    it begins is in no pair; ``rule_errors`` tells it."""
    act = rules.where("status = 'Active'")
    place = act.select(*NODE, F.struct("seq", "mapping_rule_id").alias("rule"), "effective_from", "effective_to")
    met = intervals.overlaps(place, NODE, "effective_from", "effective_to", "rule")
    left, right = F.least("a", "b"), F.greatest("a", "b")
    return met.select(left["mapping_rule_id"].alias("left_rule_id"), right["mapping_rule_id"].alias("right_rule_id"), "scope_type", "node_id", F.lit("Overlap").alias("status"))


def rule_overlaps(rules: DataFrame) -> DataFrame:
    """Every active rule with whether it overlaps one of its node that begins earlier or later, and the start of its chain of
    overlaps."""
    act = rules.where("status = 'Active'").select("mapping_rule_id", *NODE, "effective_from", "effective_to")
    return intervals.sweep(act, NODE, "effective_from", "effective_to", "mapping_rule_id")


def _exploded(nodes: DataFrame, order, *keep: str) -> DataFrame:
    """A row for each product and level, with the level's node."""
    each = F.array(*(F.struct(F.lit(scope).alias("scope_type"), F.col(node).alias("node_id")) for scope, _, node, _ in order))
    return nodes.select(*keep, "source_system_id", F.explode(each).alias("n")).select(*keep, "source_system_id", "n.scope_type", "n.node_id")


def resolve(nodes: DataFrame, rules: DataFrame, groups: DataFrame, as_of: Column, hierarchy=S.HIERARCHY) -> DataFrame:
    """The 22 columns of the effective mapping; two lineage columns a level, as many as the hierarchy has.  Products are
    exploded to (scope, node) and meet the day's rules on equal keys; one aggregation by product gathers each level's
    candidates, and the highest level that has any decides, so a conflict or an exclusion there hides what lies above."""
    order = levels(hierarchy)
    found = _exploded(nodes, order, "product_id").join(applicable(rules, as_of).select(*NODE, *RULE), NODE)
    return _decided(nodes.withColumn("as_of_date", as_of), found, groups, order, ["product_id"])


def decisions(nodes: DataFrame, rules: DataFrame, groups: DataFrame, as_of: Column, hierarchy=S.HIERARCHY) -> DataFrame:
    """The decision of ``resolve`` alone, one row a product id, with ``copies``: how many products have the id."""
    order = levels(hierarchy)
    found = _exploded(nodes, order, "product_id").join(applicable(rules, as_of).select(*NODE, *RULE), NODE)
    ids = nodes.groupBy("product_id").agg(F.count(F.lit(1)).alias("copies")).withColumn("as_of_date", as_of)
    return _decided(ids, found, groups, order, ["product_id"], products=False)


def counted(effective: DataFrame) -> DataFrame:
    """The same from a written mapping: its decisions by product id, each with ``copies``, how many rows say it."""
    return effective.groupBy("product_id", *DECISION, "as_of_date").agg(F.count(F.lit(1)).alias("copies"))


def resolve_as_of(asked: DataFrame, nodes: DataFrame, rules: DataFrame, groups: DataFrame, hierarchy=S.HIERARCHY, day: str = "as_of_date", width: int = 32, products: bool = True) -> DataFrame:
    """The same for each product and day in ``asked(product_id, day)``, once each.  The days that a node is asked for, not its
    products, meet the node's rules, by equi-join on node and bucket of days; a main category's candidates of a day are found once
    for all its products.  Without ``products`` only the decision is given, one row for each id and day asked for, also where
    several products share the id, or none has it."""
    order = levels(hierarchy)
    days = scratch.stored(asked.select("product_id", F.col(day).alias("as_of_date")).where("as_of_date IS NOT NULL").distinct(), "days")
    rows = nodes.join(days, "product_id")
    keyed = _exploded(rows, order, "product_id", "as_of_date")
    points = keyed.select(*NODE, "as_of_date").distinct()
    act = rules.where("status = 'Active'").select(*NODE, *RULE, "effective_from", "effective_to")
    met = intervals.interval_join(points, act, NODE, "as_of_date", "effective_from", "effective_to", width, intervals.extent(days, "as_of_date"))
    return _decided(rows if products else days, keyed.join(met, [*NODE, "as_of_date"]), groups, order, ["product_id", "as_of_date"], products)


def decide_as_of(facts: DataFrame, nodes: DataFrame, rules: DataFrame, groups: DataFrame, day: str, hierarchy=S.HIERARCHY) -> DataFrame:
    """The facts, each with the decision of its product id on its own ``day``.  An id has one row with the rules of its nodes, and how
    many of its products have each node; facts meet it by ``product_id`` and pick what is in effect on their day, so neither the
    days nor the products of an id make more rows, and facts that are dealt by it already are dealt no more."""
    order = levels(hierarchy)
    act = rules.where("status = 'Active'").groupBy(*NODE).agg(F.collect_list(F.struct("effective_from", "effective_to", *RULE)).alias("rules"))
    ids = _exploded(nodes, order, "product_id").groupBy("product_id", *NODE).agg(F.count(F.lit(1)).cast("int").alias("n"))
    held = ids.join(act, NODE).groupBy("product_id").agg(*(F.collect_list(F.when(F.col("scope_type") == scope, F.struct("n", "rules"))).alias(f"{name}_held") for scope, _, _, name in order))
    now = lambda r: in_effect(F.col(day), r["effective_from"], r["effective_to"])
    top = F.lit(None).cast("struct<scope:string,held:array<struct<n:int,rules:array<struct<effective_from:date,effective_to:date,mapping_rule_id:string,target_reporting_group_id:string,rule_action:string>>>>>")
    for scope, _, _, name in order:
        some = F.exists(f"{name}_held", lambda h: F.exists(h["rules"], now))
        top = F.when(some, F.struct(F.lit(scope).alias("scope"), F.col(f"{name}_held").alias("held"))).otherwise(top)
    rows = facts.join(held, "product_id", "left").select(*facts.columns, top.alias("level"))
    found = F.flatten(F.transform("level.held", lambda h: F.flatten(F.array_repeat(F.filter(h["rules"], now), h["n"]))))
    rows = rows.select(*facts.columns, F.col("level.scope").alias("scope"), found.alias("found"))
    each = lambda c: F.transform("found", lambda r: r[c])
    told = F.struct("scope", F.sort_array(each("mapping_rule_id")).alias("ids"), F.sort_array(each("target_reporting_group_id")).alias("targets"), F.array_max(each("rule_action")).alias("action"))
    rows, decision = _outcome(rows.select(*facts.columns, F.when(F.col("scope").isNotNull(), told).alias("top")), groups, order)
    return rows.select(*facts.columns, *decision)


def _decided(rows: DataFrame, found: DataFrame, groups: DataFrame, order, keys: list[str], products: bool = True) -> DataFrame:
    """The effective mapping of ``rows`` (products, with ``as_of_date``), one a key, from the candidates ``found``; without
    ``products``, the rows' own columns and the decision alone.  Groups are few and broadcast: their ids are too few to deal rows by."""
    at = lambda scope, c: F.array_sort(F.collect_list(F.when(F.col("scope_type") == scope, F.col(c))))
    by = found.groupBy(*keys).agg(
        *(at(scope, c).alias(f"{name}_{c}") for scope, _, _, name in order for c in ("mapping_rule_id", "target_reporting_group_id")),
        *(F.max(F.when(F.col("scope_type") == scope, F.col("rule_action"))).alias(f"{name}_action") for scope, _, _, name in order),
    )
    top = F.lit(None).cast("struct<scope:string,ids:array<string>,targets:array<string>,action:string>")
    for scope, _, _, name in order:
        own = F.struct(F.lit(scope).alias("scope"), F.col(f"{name}_mapping_rule_id").alias("ids"), F.col(f"{name}_target_reporting_group_id").alias("targets"), F.col(f"{name}_action").alias("action"))
        top = F.when(F.size(F.coalesce(f"{name}_mapping_rule_id", F.array().cast("array<string>"))) > 0, own).otherwise(top)
    own = rows.columns
    rows, decision = _outcome(rows.join(by, keys, "left").withColumn("top", top), groups, order)
    lineage = [F.coalesce(id_list(F.col(f"{name}_{c}")), F.lit("")).alias(f"{name}_{a}_id") for *_, name in order for c, a in (("mapping_rule_id", "rule"), ("target_reporting_group_id", "target"))]
    if not products:
        return rows.select(*own, *decision)
    return rows.select(
        "product_id", "source_system_id", "source_product_name", "sales_account", "source_main_category", "source_sub_category", "source_classification_id", *lineage,
        *decision, "main_node_id", F.col("source_classification_id").alias("subcategory_node_id"), "as_of_date",
    )


def _outcome(rows: DataFrame, groups: DataFrame, order) -> tuple[DataFrame, list[Column]]:
    """The rows with the group that their ``top`` names, and the columns of the decision."""
    rows = rows.withColumn("target", F.when((F.size("top.ids") == 1) & (F.col("top.action") != "Exclude"), F.col("top.targets")[0]))
    rows = rows.join(F.broadcast(groups.select(F.col("reporting_group_id").alias("target"), "reporting_group_name", "active")), "target", "left")
    none, many, out = F.col("top").isNull(), F.size("top.ids") > 1, F.col("top.action") == "Exclude"
    pick = lambda a, b, c, d: F.when(none, a).when(many, b).when(out, c).otherwise(d)
    explicit = F.when(F.col("top.scope") == order[-1][0], "Explicit").otherwise("Inherited")
    decision = [
        F.coalesce("target", F.lit("")).alias("effective_reporting_group_id"),
        F.coalesce("reporting_group_name", F.lit("")).alias("effective_reporting_group_name"),
        F.coalesce("top.scope", F.lit(S.UNMAPPED)).alias("resolution_source"),
        pick("Unmapped", "Explicit conflict", "Explicit exclusion", explicit).alias("resolution_state"),
        pick(S.UNMAPPED, S.CONFLICT, S.UNMAPPED, F.when(F.col("active").eqNullSafe("Yes"), S.MAPPED).otherwise(S.INACTIVE)).alias("resolution_status"),
        F.coalesce(id_list(F.col("top.ids")), F.lit("")).alias("winning_rule_id"),
    ]
    return rows, decision


def rule_errors(rules: DataFrame, hierarchy=S.HIERARCHY) -> DataFrame:
    """``check_id, entity_id, message`` of rules that no reader may accept, inactive ones included."""
    action, scope = F.col("rule_action"), F.col("scope_type")
    wrong = (
        F.when(~action.isin("Map", "Exclude"), "unknown action")
        .when(~scope.isin([h[0] for h in hierarchy]), "unknown scope type")
        .when((action == "Exclude") & (scope != S.PRODUCT), "only a product can be excluded")
        .when((action == "Exclude") & (F.col("target_reporting_group_id") != ""), "an exclusion has no target")
        .when((action == "Map") & (F.col("target_reporting_group_id") == ""), "a map rule needs a target")
        .when(F.col("effective_to") < F.col("effective_from"), "the interval ends before it begins")
    )
    return rules.select(F.lit("rule").alias("check_id"), F.col("mapping_rule_id").alias("entity_id"), wrong.alias("message")).where("message IS NOT NULL")


def deactivate(rules: DataFrame, rule_id: str) -> DataFrame:
    """The rules with one made inactive; an unknown id is an error when the result is read."""
    known = rules.agg(F.max(F.when(F.col("mapping_rule_id") == rule_id, 1)).alias("known"))
    checked = rules.join(known.where(F.coalesce("known", F.raise_error(F.lit(f"no rule {rule_id}")).cast("int")) == 1), how="cross")
    return checked.withColumn("status", F.when(F.col("mapping_rule_id") == rule_id, "Inactive").otherwise(F.col("status"))).drop("known")


def levels_of(rules: DataFrame) -> DataFrame:
    return rules.withColumn("hierarchy_level", hierarchy_level("scope_type"))
