import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.functions import fingerprint, scalar
from mixlens.operators import aggregates, kpi, mapping, sinks, validation
from mixlens.operators.bridge import metric_bridge
from mixlens.plans.refresh import Model, refresh

DAY, FIRST = dt.date(2026, 8, 11), dt.date(1899, 12, 31)
# The seven facts, rules and groups that published totals belong to.
NODES = [(f"PRD-{k}", "SRC-1", f"Product {k}", "ACC", x, x, f"SUB-{x}", f"MAIN-{x}") for k, x in enumerate("ABCDE", 1)]
NAMES = "product_id source_system_id source_product_name sales_account source_main_category source_sub_category source_classification_id main_node_id".split()
GROUPS = [("RPG-0001", "Add-ons", "Yes", 10), ("RPG-0002", "Drinks", "Yes", 20), ("RPG-0003", "Retired", "No", 30)]
RULES = [
    (i, "SRC-1", scope, node, group, "Map", FIRST, None, "Active", k)
    for k, (i, scope, node, group) in enumerate(
        [("MAP-1", S.MAIN, "MAIN-A", "RPG-0001"), ("MAP-2", S.PRODUCT, "PRD-2", "RPG-0002"), ("MAP-3", S.PRODUCT, "PRD-4", "RPG-0001"), ("MAP-4", S.PRODUCT, "PRD-4", "RPG-0002"), ("MAP-5", S.PRODUCT, "PRD-5", "RPG-0003")]
    )
]
ROWS = [
    ("F-1", "IMP-CURRENT", 1, "CAT-A", "In-house", 2, 100), ("F-2", "IMP-CURRENT", 2, "CAT-B", "In-house", 1, 50), ("F-3", "IMP-CURRENT", 3, "CAT-C", "In-house", 3, 30),
    ("F-4", "IMP-CURRENT", 4, "CAT-B", "Takeaway", 4, 40), ("F-5", "IMP-CURRENT", 5, "CAT-D", "Takeaway", 5, 20), ("F-6", "IMP-COMPARE", 1, "CAT-A", "In-house", 1, 80), ("F-7", "IMP-CURRENT", 2, "CAT-B", "In-house", 10, 999),
]
FACTS = "sales_fact_id string, import_id string, restaurant_id string, product_id string, legacy_reporting_category_id string, period_start date, period_end date, reporting_channel string, quantity decimal(18,2), sales_amount decimal(18,2), publication_state string"


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        (f, i, "RST-2" if f in ("F-4", "F-5") else "RST-1", f"PRD-{p}", c, DAY, DAY, ch, Decimal(q), Decimal(s), "Superseded" if f == "F-7" else S.ACTIVE_FINALIZED)
        for f, i, p, c, ch, q, s in ROWS
    ]
    facts = spark.createDataFrame(rows, FACTS)
    rules, groups = spark.createDataFrame(RULES, S.RULES), spark.createDataFrame(GROUPS, S.GROUPS)
    effective = mapping.resolve(spark.createDataFrame(NODES, NAMES), rules, groups, F.lit(DAY)).cache()
    return facts, rules, groups, effective, metric_bridge(facts, effective).cache()


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_bridge_is_one_to_one_with_all_states(world):
    facts, *_, bridge = world
    assert bridge.columns == S.BRIDGE and bridge.count() == facts.count() == 7
    assert {r[0] for r in bridge.select("resolution_status").distinct().collect()} == set(S.MAPPING_STATES)
    assert validation.bridge_errors(facts, bridge, F.lit(DAY)).count() == 0


def test_totals_states_and_groups(world):
    *_, bridge = world
    assert tuple(aggregates.totals(bridge).first()) == (7, 1319, 26)
    now = aggregates.state_coverage(bridge).where("import_id = 'IMP-CURRENT' AND channel_scope = 'All channels'")
    assert rows_of(now, "resolution_status", "fact_count", "sales_nok", "quantity") == {("Mapped", 2, 150, 3), ("Unmapped", 1, 30, 3), ("Conflict", 1, 40, 4), ("Inactive Target", 1, 20, 5)}
    groups = aggregates.group_totals(bridge).where("import_id = 'IMP-CURRENT' AND channel_scope = 'All channels'")
    assert rows_of(groups, "reporting_group_id", "fact_count", "sales_nok", "quantity") == {("RPG-0001", 1, 100, 2), ("RPG-0002", 1, 50, 1)}


def test_everything_reconciles(world):
    facts, *_, bridge = world
    assert {r["result"] for r in aggregates.reconciliation(facts, bridge).collect()} == {"PASS"}
    assert "FAIL" in {r["result"] for r in aggregates.reconciliation(facts, bridge.where("sales_fact_id <> 'F-4'")).collect()}


def test_unknown_state_is_an_error(world):
    *_, bridge = world
    with pytest.raises(Exception, match="unknown mapping state"):
        aggregates.state_coverage(bridge.withColumn("resolution_status", F.lit("Other"))).collect()


def test_legacy_comparison_and_crosswalk(spark, world):
    *_, bridge = world
    defs = spark.createDataFrame([("LEGACY-EQ-001", "RPG-0001", "CAT-A", "Equivalent", "Yes"), ("LEGACY-EQ-002", "RPG-0002", "CAT-B", "Equivalent", "Yes")], "definition_id string, reporting_group_id string, legacy_category_id string, comparison_status string, active string")
    now = aggregates.legacy_comparison(bridge, defs).where("import_id = 'IMP-CURRENT' AND channel_scope = 'All channels'")
    assert rows_of(now, "definition_id", "legacy_sales_nok", "group_sales_nok", "variance_sales_nok", "result") == {("LEGACY-EQ-001", 100, 100, 0, "PASS"), ("LEGACY-EQ-002", 90, 50, -40, "VARIANCE")}
    states = {r["resolution_status"] for r in aggregates.crosswalk(bridge).collect()}
    assert {"Conflict", "Inactive Target"} <= states


def shares(spark, world, ids):
    _, _, groups, _, bridge = world
    imports = spark.createDataFrame([("IMP-COMPARE",), ("IMP-CURRENT",)], "import_id string")
    return kpi.share_results(bridge, imports, groups, spark.createDataFrame([(i, i) for i in ids], "restaurant_id string, restaurant_name string"))


def test_share_grid(spark, world):
    got = shares(spark, world, ["RST-2", "RST-1"]).collect()
    assert len(got) == 12 == len({r["metric_result_id"] for r in got})
    value = {(r["import_id"], r["reporting_group_id"], r["scope_type"], r["restaurant_id"]): (r["numerator"], r["denominator"], r["metric_value"]) for r in got}
    assert value["IMP-CURRENT", "RPG-0001", "Company", ""] == (100, 240, 100 / 240)
    assert value["IMP-CURRENT", "RPG-0002", "Company", ""] == (50, 240, 50 / 240)
    assert value["IMP-CURRENT", "RPG-0001", "Restaurant", "RST-1"] == (100, 180, 100 / 180)
    assert value["IMP-CURRENT", "RPG-0001", "Restaurant", "RST-2"] == (0, 60, 0)
    assert value["IMP-COMPARE", "RPG-0001", "Company", ""] == (80, 80, 1)
    assert value["IMP-COMPARE", "RPG-0002", "Restaurant", "RST-2"] == (0, 0, 0)


def test_deselected_restaurant_leaves_both_sides(spark, world):
    facts = world[0]
    got = shares(spark, world, ["RST-1"]).collect()
    assert len(got) == 8
    assert {(r["numerator"], r["denominator"]) for r in got if r["import_id"] == "IMP-CURRENT" and r["scope_type"] == "Company"} == {(100, 180), (50, 180)}
    split = aggregates.enabled_split(facts, spark.createDataFrame([("RST-1",)], "restaurant_id string")).first()
    assert (split["enabled_fact_count"], split["excluded_fact_count"], split["complete_fact_count"]) == (5, 2, 7)


def test_fingerprints(spark, world):
    _, rules, groups, effective, _ = world
    a = fingerprint.mapping_fingerprint(effective, rules, groups, F.lit(DAY)).first()[0]
    b = fingerprint.mapping_fingerprint(effective.orderBy(F.desc("product_id")), rules.orderBy(F.desc("seq")), groups, F.lit(DAY)).first()[0]
    c = fingerprint.mapping_fingerprint(effective, rules, groups.withColumn("active", F.lit("Yes")), F.lit(DAY)).first()[0]
    assert a == b != c and a.startswith("MAP-") and len(a) == 20

    def brute(text):
        l = r = 0
        for u in range(0, len(e := text.encode("utf-16-be")), 2):
            code = e[u] << 8 | e[u + 1]
            l, r = (l * 131 + code) % 2147483647, (r * 137 + code) % 2147483629
        return f"{l:08x}{r:08x}"

    for text in ("", "abc", "Poké 😀"):
        assert spark.createDataFrame([(text,)], "x string").select(fingerprint.hash_text("x")).first()[0] == brute(text + "\n")
    texts = ["b", "a|1:x", "é😀"]
    got = fingerprint.hash_records(spark.createDataFrame([(t,) for t in texts], "record string"), "MAP-").first()[0]
    assert got == "MAP-" + brute("".join(t + "\n" for t in sorted(texts)))


def test_coercions(spark):
    df = spark.createDataFrame([("　 a\t", "12.50"), (None, "x"), ("b", "NaN"), ("c", "Infinity"), ("d", None)], "t string, n string")
    got = df.select(scalar.text("t"), scalar.number("n")).collect()
    assert [tuple(r) for r in got] == [("a", Decimal("12.50")), ("", 0), ("b", 0), ("c", 0), ("d", 0)]
    one = spark.range(1)
    assert one.select(scalar.delimited(F.lit(" b,a, ,c "))).first()[0] == "a, b, c"
    assert one.select(scalar.share(F.lit(1), F.lit(0))).first()[0] == 0.0
    week = one.select(F.lit(DAY).alias("a"), F.lit(DAY).alias("b"), F.lit(31).alias("w"), F.lit(2026).alias("y"))
    assert week.select(scalar.period_label("a", "b", "w", "y")).first()[0] == "Week 31 2026"
    assert week.select(scalar.period_label("a", "b")).first()[0] == "11.08.2026–11.08.2026"


def test_corrupted_bridges_are_rejected(world):
    facts, *_, effective, bridge = world[0], *world[1:]
    kinds = lambda b, mark="": {r["check_id"] for r in validation.bridge_errors(facts, b, F.lit(DAY), mark).collect()}
    assert kinds(bridge.where("sales_fact_id <> 'F-1'")) == {"bridge-fact"}
    assert "bridge-duplicate" in kinds(bridge.union(bridge.where("sales_fact_id = 'F-1'")))
    assert kinds(bridge.withColumn("mapping_as_of_date", F.lit(FIRST))) == {"bridge-day"}
    assert kinds(bridge, "MAP-other") == {"bridge-fingerprint"}
    assert "fact-duplicate" in {r["check_id"] for r in validation.bridge_errors(facts.union(facts), bridge, F.lit(DAY)).collect()}
    swapped = bridge.withColumn("import_id", F.when(F.col("sales_fact_id") == "F-2", F.lit(None)).otherwise(F.col("import_id")))
    assert {(r["check_id"], r["entity_id"], r["message"]) for r in validation.bridge_errors(facts, swapped, F.lit(DAY)).collect()} == {("bridge-fact", "F-2", "lineage differs")}
    assert {r["check_id"] for r in validation.totals_errors(facts, bridge.where("sales_fact_id <> 'F-1'")).collect()} == {"bridge-fact", "bridge-sales", "bridge-quantity"}
    assert validation.cutover_errors(facts, bridge, F.lit(DAY)).count() == 0
    assert validation.freshness_errors(effective, effective.where("product_id <> 'PRD-1'"), F.lit(DAY)).first()["message"] == "missing"


def test_refresh_replaces_only_what_is_valid(spark, tmp_path):
    model = Model.bind(spark, "/root/testdata/sf0.001")
    out = str(tmp_path)
    mark = refresh(model, out)
    before = fingerprint.content_snapshot(spark.read.parquet(f"{out}/bridge").drop("metric_refresh_at")).first()
    assert before["rows"] == 6000 and mark.startswith("MAP-")
    model.rules = model.rules.withColumn("rule_action", F.lit("Maybe"))
    with pytest.raises(validation.ValidationError):
        refresh(model, out)
    assert fingerprint.content_snapshot(spark.read.parquet(f"{out}/bridge").drop("metric_refresh_at")).first() == before


def test_staged_tables_that_are_wrong_are_rejected(spark, tmp_path, monkeypatch, world):
    facts, *_, bridge = world
    path, check = str(tmp_path / "bridge"), lambda rows: validation.cutover_errors(facts, rows, F.lit(DAY))
    sinks.write_validated(bridge, path, check, S.BRIDGE, ("import_id",))
    assert {p.name for p in (tmp_path / "bridge").iterdir() if p.is_dir()} == {"import_id=IMP-COMPARE", "import_id=IMP-CURRENT"}
    with pytest.raises(validation.ValidationError, match="bridge-sales"):
        sinks.write_validated(bridge.withColumn("sales_amount", F.col("sales_amount") + 1).select(*S.BRIDGE), path, check, S.BRIDGE, ("import_id",))
    from mixlens.sources import tables

    assert tables.bridge(spark.read.schema(bridge.schema).parquet(path)).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["bridge"]
    results = shares(spark, world, ["RST-1", "RST-2"]).cache()
    out = str(tmp_path / "results")
    sinks.write_validated(results, out, lambda rows: validation.result_errors(results, rows))
    with pytest.raises(validation.ValidationError, match="differs"):
        sinks.write_validated(results.withColumn("numerator", F.lit(1).cast("decimal(38,2)")).select(*results.columns), out, lambda rows: validation.result_errors(results, rows))
    assert validation.result_errors(results, spark.read.parquet(out)).count() == 0


def test_repeated_dimension_keys_are_errors(spark):
    from mixlens.sources import tables

    groups = spark.createDataFrame([*GROUPS, GROUPS[0]], S.GROUPS)
    with pytest.raises(Exception, match="twice"):
        tables.reporting_groups(groups).collect()
    rows = [("IMP-1", DAY, DAY, "Active Finalized", "Yes")] * 2
    with pytest.raises(Exception, match="twice"):
        tables.active_imports(spark.createDataFrame(rows, "import_id string, period_start date, period_end date, publication_state string, active_version string")).collect()


def test_protected_tables_may_not_change(spark, world):
    from mixlens.plans.refresh import changed_tables

    facts, rules, *_ = world
    before = fingerprint.protected_snapshot({"facts": facts, "rules": rules})
    assert changed_tables(before, fingerprint.protected_snapshot({"facts": facts.orderBy(F.desc("quantity")), "rules": rules})).count() == 0
    after = fingerprint.protected_snapshot({"facts": facts.where("sales_fact_id <> 'F-1'"), "rules": rules})
    assert [r["entity_id"] for r in changed_tables(before, after).collect()] == ["facts"]


def test_hierarchy_needs_its_columns(spark, world):
    with pytest.raises(ValueError, match="node column"):
        mapping.levels((*S.HIERARCHY, ("Brand", 4)))


def test_selection_labels_have_to_be_unique(spark):
    rows = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3")], "label string, import_id string")
    one = spark.range(1)
    assert [one.select(kpi.id_of(rows, F.lit(x), "label", "import_id")).first()[0] for x in ("B", "C")] == ["3", None]
    with pytest.raises(Exception, match="several rows"):
        one.select(kpi.id_of(rows, F.lit("A"), "label", "import_id")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A-000007", 1), ("x", 2)], "k string, v int")
    path = str(tmp_path / "t")
    assert sinks.create_if_absent(df, path) and not sinks.create_if_absent(df, path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="columns"):
        sinks.write_checked(df, path, columns=["k"])
    up = sinks.upsert(df, spark.createDataFrame([("x", 9), ("y", 3)], "k string, v int"), "k")
    assert {tuple(r) for r in up.collect()} == {("A-000007", 1), ("x", 9), ("y", 3)}
    new = sinks.next_ids(spark.createDataFrame([(5, ""), (4, "")], "o int, k string"), df, "k", "A-", ["o"])
    assert {tuple(r) for r in new.select("o", "k").collect()} == {(4, "A-000008"), (5, "A-000009")}


def test_streamed_bridge(spark, tmp_path, world):
    from mixlens.streaming import imports

    facts, _, _, effective, _ = world
    rows = facts.withColumn("arrived_at", F.lit("2026-08-11 10:00:00").cast("timestamp"))
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = imports.start(stream, effective, str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
