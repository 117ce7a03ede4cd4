import datetime as dt

import pytest
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions.scalar import serial_date
from mixlens.operators import mapping, validation
from mixlens.plans import migration
from mixlens.plans.decisions import decisions

DAY = dt.date(2026, 8, 11)
FIRST = dt.date(1899, 12, 31)
NODES = [("PRD-1", "SRC-1", "A product", "ACC", "Drinks", "Beer", "SCL-1", "SRC-1 || Main || Drinks")]
NAMES = "product_id source_system_id source_product_name sales_account source_main_category source_sub_category source_classification_id main_node_id".split()
GROUPS = [("RPG-0001", "One", "Yes", 10), ("RPG-0002", "Two", "Yes", 20), ("RPG-0003", "Three", "No", 30)]


def rule(k, scope, node, target, action="Map", a=FIRST, b=None, status="Active"):
    return (f"MAP-{k}", "SRC-1", scope, node, target, action, a, b, status, k)


MAIN = rule(1, S.MAIN, "SRC-1 || Main || Drinks", "RPG-0001")
SUB = rule(2, S.SUB, "SCL-1", "RPG-0002")
OWN = rule(3, S.PRODUCT, "PRD-1", "RPG-0001")
OUT = rule(4, S.PRODUCT, "PRD-1", "", "Exclude")


def resolved(spark, *rules, day=DAY):
    df = mapping.resolve(spark.createDataFrame(NODES, NAMES), spark.createDataFrame(list(rules), S.RULES), spark.createDataFrame(GROUPS, S.GROUPS), F.lit(day))
    assert df.columns == S.EFFECTIVE
    r = df.collect()
    assert len(r) == 1
    return tuple(r[0][c] for c in ("effective_reporting_group_id", "resolution_source", "resolution_state", "resolution_status", "winning_rule_id"))


def off(r):
    return (*r[:8], "Inactive", r[9])


@pytest.mark.parametrize(
    ("rules", "want"),
    [
        ([], ("", "Unmapped", "Unmapped", "Unmapped", "")),
        ([MAIN], ("RPG-0001", S.MAIN, "Inherited", "Mapped", "MAP-1")),
        ([MAIN, SUB], ("RPG-0002", S.SUB, "Inherited", "Mapped", "MAP-2")),
        ([SUB, OWN, MAIN], ("RPG-0001", S.PRODUCT, "Explicit", "Mapped", "MAP-3")),
        ([SUB, off(OWN)], ("RPG-0002", S.SUB, "Inherited", "Mapped", "MAP-2")),
        ([MAIN, OUT], ("", S.PRODUCT, "Explicit exclusion", "Unmapped", "MAP-4")),
        ([MAIN, off(OUT)], ("RPG-0001", S.MAIN, "Inherited", "Mapped", "MAP-1")),
        ([MAIN, OWN, OUT], ("", S.PRODUCT, "Explicit conflict", "Conflict", "MAP-3, MAP-4")),
        ([MAIN, SUB, rule(5, S.SUB, "SCL-1", "RPG-0001")], ("", S.SUB, "Explicit conflict", "Conflict", "MAP-2, MAP-5")),
        ([rule(6, S.MAIN, MAIN[3], "RPG-0003")], ("RPG-0003", S.MAIN, "Inherited", "Inactive Target", "MAP-6")),
        ([rule(6, S.PRODUCT, "PRD-1", "RPG-9999")], ("RPG-9999", S.PRODUCT, "Explicit", "Inactive Target", "MAP-6")),
        ([rule(7, S.SUB, "SCL-1", "RPG-0002", b=DAY), MAIN], ("RPG-0002", S.SUB, "Inherited", "Mapped", "MAP-7")),
        ([rule(7, S.SUB, "SCL-1", "RPG-0002", b=dt.date(2026, 8, 10)), MAIN], ("RPG-0001", S.MAIN, "Inherited", "Mapped", "MAP-1")),
        ([rule(7, S.SUB, "SCL-1", "RPG-0002", a=dt.date(2026, 8, 12)), MAIN], ("RPG-0001", S.MAIN, "Inherited", "Mapped", "MAP-1")),
    ],
)
def test_most_specific_rule_wins(spark, rules, want):
    assert resolved(spark, *rules) == want


def test_conflicts_need_an_overlap(spark):
    a = rule(1, S.SUB, "N", "RPG-0001", b=dt.date(2026, 1, 10))
    b = rule(2, S.SUB, "N", "RPG-0002", a=dt.date(2026, 1, 10))
    c = rule(3, S.SUB, "N", "RPG-0002", a=dt.date(2026, 1, 11), b=dt.date(2026, 1, 12))
    d = off(rule(4, S.SUB, "N", "RPG-0002"))
    found = mapping.rule_conflicts(spark.createDataFrame([a, b, c, d], S.RULES)).collect()
    assert sorted((r["left_rule_id"], r["right_rule_id"]) for r in found) == [("MAP-1", "MAP-2"), ("MAP-2", "MAP-3")]


def test_invalid_rules_are_told(spark):
    rules = [rule(1, S.SUB, "N", "", "Exclude"), rule(2, S.PRODUCT, "P", "RPG-0001", "Exclude"), rule(3, S.MAIN, "N", ""), rule(4, "Other", "N", "RPG-0001"), rule(5, S.SUB, "N", "RPG-0001", "Maybe"), rule(6, S.MAIN, "N", "RPG-0001")]
    errors = mapping.rule_errors(spark.createDataFrame(rules, S.RULES))
    assert {r["entity_id"] for r in errors.collect()} == {"MAP-1", "MAP-2", "MAP-3", "MAP-4", "MAP-5"}
    with pytest.raises(validation.ValidationError):
        validation.raise_if_any(errors)


def test_serial_days(spark):
    r = spark.range(1).select(serial_date(F.lit(46245)).alias("d"), serial_date(F.lit(0)).alias("o"), serial_date(F.lit(25569)).alias("e")).first()
    assert r["d"] == DAY and r["o"] is None and r["e"] == dt.date(1970, 1, 1)


def test_migration_is_idempotent(spark):
    wanted, day = decisions(spark), F.lit(DAY)
    assert wanted.count() == 129
    old = spark.createDataFrame([("MAP-000001", "SRC-TEST-SALES", S.MAIN, "SRC-TEST-SALES || Main || Add-ons", "RPG-0001", "Map", FIRST, None, "Active", 0)], S.RULES)
    assert migration.decision_errors(old, wanted, day).count() == 0
    planned = migration.plan(old, wanted, day)
    assert {r["plan"]: r["count"] for r in planned.groupBy("plan").count().collect()} == {"reuse": 1, "add": 128}
    new = migration.additions(planned, day).select(old.columns)
    ids = sorted(r[0] for r in new.select("mapping_rule_id").collect())
    assert (ids[0], ids[-1], len(set(ids))) == ("MAP-000002", "MAP-000129", 128)
    again = migration.plan(old.unionByName(new), wanted, day)
    assert {r["plan"]: r["count"] for r in again.groupBy("plan").count().collect()} == {"reuse": 129}
    other = old.withColumn("target_reporting_group_id", F.lit("RPG-0009"))
    assert [r["check_id"] for r in migration.decision_errors(other, wanted, day).collect()] == ["decision-conflict"]


def test_rules_are_authored_and_ended(spark):
    from mixlens.plans import authoring

    nodes, groups = spark.createDataFrame(NODES, NAMES), spark.createDataFrame(GROUPS, S.GROUPS)
    rules = authoring.add_rule(spark.createDataFrame([MAIN], S.RULES), nodes, groups, "SRC-1", S.PRODUCT, "PRD-1", "RPG-0002", F.lit(DAY))
    assert {r[0] for r in rules.select("mapping_rule_id").collect()} == {"MAP-1", "MAP-000002"}
    assert mapping.resolve(nodes, rules, groups, F.lit(DAY)).first()["effective_reporting_group_id"] == "RPG-0002"
    ended = authoring.end_rule(rules, "MAP-000002")
    assert mapping.resolve(nodes, ended, groups, F.lit(DAY)).first()["effective_reporting_group_id"] == "RPG-0001"
    with pytest.raises(Exception, match="no rule"):
        authoring.end_rule(rules, "MAP-9").collect()
    for bad in (("PRD-9", "RPG-0001"), ("PRD-1", "RPG-0003")):
        with pytest.raises(validation.ValidationError):
            authoring.add_rule(rules, nodes, groups, "SRC-1", S.PRODUCT, *bad, F.lit(DAY))
    log = spark.createDataFrame([("LOG-000007",)], "log_id string")
    assert authoring.log_line(log, "refresh", "ok", "mapping", "").first()["log_id"] == "LOG-000008"
