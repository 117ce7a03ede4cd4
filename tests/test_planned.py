"""Planned metrics, metrics from rows, hash trees, names in order, fingerprints in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlens import dated_queries
from mixlens.functions import fingerprint, merkle
from mixlens.operators import kpi, metrics, ordering, planned
from mixlens.plans.refresh import Model

ROOT = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sketches_are_near_the_exact_rates(spark):
    m = Model.bind(spark, "/root/testdata/sf0.01")
    rows = dated_queries._baskets(m)
    exact = {tuple(r[:4]): r for r in planned.attach_rate(rows, m.imports, m.groups, m.restaurants).collect()}
    found = planned.sketched_attach_rate(planned.basket_sketches(rows, m.imports, m.restaurants)).collect()
    assert len(found) == sum(r["group_baskets"] > 0 for r in exact.values())
    off = [abs(r[c] - exact[tuple(r[:4])][c]) / exact[tuple(r[:4])][c] for r in found for c in ("group_baskets", "baskets")]
    assert max(off) < 5 * 0.0163 and np.mean(np.square(off)) ** 0.5 < 1.5 * 0.0163


def test_bitmaps_merge_over_loads(spark):
    m = Model.bind(spark, ROOT)
    rows = dated_queries._baskets(m).cache()
    keys = ["import_id", "restaurant_id", "reporting_group_id", "bucket"]
    half = [planned.basket_bitmaps(rows.where(F.pmod(F.xxhash64("sales_fact_id"), F.lit(2)) == k)) for k in (0, 1)]
    both = half[0].union(half[1]).groupBy(*keys).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    assert rows_of(both.select(*keys, F.hex("bitmap"))) == rows_of(planned.basket_bitmaps(rows).select(*keys, F.hex("bitmap")))


def test_parts_add_up(spark):
    m = Model.bind(spark, ROOT)
    shares, chosen = m.shares().cache(), kpi.defaults(m.imports)
    told = {r["reporting_group_id"]: r["change"] for r in kpi.comparison(kpi.lookup(shares, scope_type="Company"), chosen).collect()}
    for r in planned.change_summary(shares, chosen).collect():
        assert r["rate"] + r["mix"] + r["rounding"] == r["change"] and abs(r["rounding"]) <= 100
        assert r["impact_cents"] + r["volume_cents"] == r["change_cents"]
        assert r["change"] / planned.UNIT == pytest.approx(told[r["reporting_group_id"]], abs=3e-12)
    one = kpi.defaults(m.imports).withColumn("comparison_import", F.col("current_import"))
    assert {tuple(r)[3:7] for r in planned.change_summary(shares, one).collect()} == {(0, 0, 0, 0)}


def test_trend_over_missing_weeks(spark):
    days = [("R", d, s) for d, s in (("2024-01-01", 10), ("2024-01-09", 30), ("2024-02-05", 20), ("2024-02-06", 20))] + [("Q", "2024-01-02", 5), ("P", "2024-01-03", 5)]
    rows = spark.createDataFrame(days, "restaurant_id string, day string, amount int").select(
        "restaurant_id", F.col("day").cast("date").alias("day"), F.col("amount").cast("decimal(18,2)").alias("sales_amount"), F.lit("Active Finalized").alias("publication_state"),
        F.when(F.col("day") == "2024-02-06", "Unmapped").otherwise("Mapped").alias("resolution_status"), F.lit("G").alias("effective_reporting_group_id"),
    )
    groups = spark.createDataFrame([("G", "Yes"), ("H", "No")], "reporting_group_id string, active string")
    got = planned.trend(rows, spark.createDataFrame([("R",), ("Q",), ("P",)], "restaurant_id string"), groups, "day").where("restaurant_id = 'R'").orderBy("week").collect()
    assert [(str(r["week"]), r["week_share"], r["weeks_counted"], r["weeks_since"], r["moving_share"]) for r in got] == [("2024-01-01", 1.0, 1, None, 1.0), ("2024-01-08", 1.0, 2, 1, 1.0), ("2024-02-05", 0.5, 1, 4, 0.5)]
    assert got[0]["rank"] == 1 and got[2]["change"] == -0.5
    assert planned.trend(rows.limit(0), spark.createDataFrame([("R",)], "restaurant_id string"), groups, "day").count() == 0


def test_metric_rows_that_cannot_be_computed(spark):
    m = Model.bind(spark, ROOT)
    for rows, said in (([("A", "profit", "", {}, None)], "unknown measure"), ([("A", "quantity", "nowhere", {}, None)], "unknown column"), ([("A", "quantity", "", {"no": ["x"]}, None)], "unknown column"), ([("A", "quantity", "", {}, None)] * 2, "not unique")):
        with pytest.raises(metrics.MetricError, match=said):
            metrics.compute(metrics.definitions(spark, rows), m.bridge(), m.imports, m.restaurants)


def test_one_scan_for_all_metrics(spark):
    m = Model.bind(spark, ROOT)
    made = metrics.compute(metrics.definitions(spark, dated_queries._SHARE_ROWS), m.bridge(), m.imports, m.restaurants)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice#") > 0 and sum("FileScan" in x and "l_extendedprice" in x for x in plan.splitlines()) == 1


def test_trees_find_what_changed(spark):
    rows = [(k, f"v{k}") for k in range(400)] + [(7, "twice"), (None, "no key")]
    later = [r for r in rows if r[0] not in (3, 7)] + [(3, "changed"), (7, "twice"), (1000, "new")]
    a, b = spark.createDataFrame(rows, "k int, v string"), spark.createDataFrame(later, "k int, v string")
    for depth in (1, 3):
        x, y = merkle.tree(a, "k", depth), merkle.tree(b, "k", depth)
        leaves = merkle.changed_leaves(x, y, depth)
        assert {tuple(r) for r in merkle.changed_rows(a, b, "k", leaves, depth).collect()} == {(3, "changed"), (7, "changed"), (1000, "added")}
        assert 1 <= leaves.count() <= 3 and merkle.changed_leaves(x, x, depth).count() == 0
        half = [merkle.tree(a.where(w), "k", depth) for w in ("k < 100", "k >= 100 OR k IS NULL")]  # partial trees add up
        whole = half[0].union(half[1]).groupBy("level", "node").agg(F.sum("rows"), F.sum("content").cast("decimal(38,0)"))
        assert rows_of(whole) == rows_of(x)
    assert merkle.changed_leaves(merkle.tree(a.limit(0), "k"), merkle.tree(a, "k")).agg(F.sum("rows_after")).first()[0] == len(rows)


def test_names_are_ordered_as_a_language_does(spark):
    names = ["Ål", "al", "Zoo", "Ærlig", "Bo", "bo", "Østen", "Éva", "Eva", "eve"]
    df = spark.createDataFrame([(n, "R") for n in names], "restaurant_name string, restaurant_id string")
    order = lambda c: [r["restaurant_name"] for r in ordering.numbered(df, ordering.RESTAURANTS, c).orderBy("position").collect()]
    assert order("UNICODE") == ["Ærlig", "al", "Ål", "bo", "Bo", "Eva", "Éva", "eve", "Østen", "Zoo"]
    assert order("UTF8_BINARY") == sorted(names)
    assert [r["restaurant_name"] for r in ordering.arranged(df, ordering.RESTAURANTS).collect()] == order("UNICODE")


def test_fold_of_records(spark):
    own = random.Random(1)
    texts = ["".join(own.choice("abc|:1é😀") for _ in range(own.randrange(40))) for _ in range(300)]
    want = []
    for b, m in fingerprint.POLYNOMIALS:
        h = 0
        for t in sorted(texts):
            for unit in [int.from_bytes(t.encode("utf-16-be")[k : k + 2]) for k in range(0, len(t.encode("utf-16-be")), 2)] + [10]:
                h = (h * b + unit) % m
        want.append(f"{h:08x}")
    df = spark.createDataFrame([(t,) for t in texts], "record string").repartition(7)
    assert fingerprint.hash_records(df, "X-").first()[0] == "X-" + "".join(want)
    e = np.array([0, 1, 2, 77, 2**40 + 5], np.uint64)
    assert fingerprint.powers(131, e, 2147483647).tolist() == [pow(131, int(x), 2147483647) for x in e]


def test_numbers_over_many_ranges(spark):
    own = random.Random(3)
    rows = [(own.choice("abé😀Z") * own.randint(0, 3), own.randrange(9), k) for k in range(500)] + [(None, 1, 999)]
    df = spark.createDataFrame(rows, "restaurant_name string, n int, k int").repartition(6)
    for collation in ("UNICODE", "UTF8_BINARY"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = ordering.numbered(df, ("restaurant_name", "n", "k"), collation).orderBy("position").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = ordering.arranged(df.coalesce(1), ("restaurant_name", "n", "k"), collation).collect()
        assert [r["position"] for r in got] == list(range(1, 502)) and [r["k"] for r in got] == [r["k"] for r in want]
    assert ordering.numbered(df.limit(0), ("n",)).collect() == []
