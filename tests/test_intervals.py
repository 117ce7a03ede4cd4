"""Interval joins, sweeps and as-of resolution against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mixlens import schema as S
from mixlens.operators import bridge, intervals, mapping
from mixlens.plans.refresh import Model
from mixlens.sources import binding, dated

DAY0 = dt.date(2020, 1, 1)
FIELDS = "k string, i int, f date, t date"


def some(n, seed, open_start=True):
    """Intervals of a few keys; half of all have one key; some open, some repeated, some ending before they begin."""
    own, rows = random.Random(seed), []
    for i in range(n):
        f = DAY0 + dt.timedelta(own.randrange(1500))
        t = f + dt.timedelta(own.choice([-3, 0, 0, 5, 20, 200, 900]))
        rows.append(("hot" if own.random() < 0.5 else f"k{own.randrange(9)}", i, None if open_start and own.random() < 0.04 else f, None if own.random() < 0.05 else t))
    return rows


low, high = lambda d: d or dt.date.min, lambda d: d or dt.date.max


def test_points_in_intervals(spark):
    own, rows = random.Random(1), some(120, 2)
    points = [(f"k{own.randrange(9)}" if own.random() < 0.5 else "hot", j, DAY0 + dt.timedelta(own.randrange(-400, 2500))) for j in range(150)] + [("hot", 999, None)]
    p, v = spark.createDataFrame(points, "k string, j int, d date"), spark.createDataFrame(rows, FIELDS)
    want = sorted((k, j, i) for k, j, d in points for k2, i, f, t in rows if d and k == k2 and low(f) <= d <= high(t))
    for width in (1, 32, 5000):
        met = intervals.interval_join(p, v, ["k"], "d", "f", "t", width)
        assert sorted((r["k"], r["j"], r["i"]) for r in met.collect()) == want
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert intervals.interval_join(p.limit(0), v, ["k"], "d", "f", "t").collect() == [] == intervals.interval_join(p, v.limit(0), ["k"], "d", "f", "t").collect()


def test_sweep_and_pairs(spark):
    rows = some(160, 3)
    v = spark.createDataFrame(rows, FIELDS)
    real = sorted((k, low(f), i, high(t)) for k, i, f, t in rows if low(f) <= high(t))
    pairs = [(a, b) for x, a in enumerate(real) for b in real[x + 1 :] if a[0] == b[0] and b[1] <= a[3]]
    for width in (1, 64, 9000):
        got = {r["i"]: r for r in intervals.sweep(v, ["k"], "f", "t", "i", width).collect()}
        assert set(got) == {r[2] for r in real}
        chain = {}
        for k, f, i, t in real:
            reach = chain.setdefault(k, [f, f, dt.date.min])
            if f > reach[2]:
                reach[0] = f
            reach[2] = max(reach[2], t)
            r = got[i]
            assert r["overlaps_earlier"] == any(b[2] == i for _, b in pairs) and r["overlaps_later"] == any(a[2] == i for a, _ in pairs)
            assert low(r["cluster_from"]) == reach[0]
    met = intervals.overlaps(v, ["k"], "f", "t", "i")
    assert sorted((r["k"], r["a"], r["b"]) for r in met.collect()) == sorted((a[0], a[2], b[2]) for a, b in pairs)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_conflicts_come_in_input_order(spark):
    row = lambda i, seq, f, t, status="Active": (i, "S", S.MAIN, "N", "G", "Map", f, t, status, seq)
    d = lambda n: DAY0 + dt.timedelta(n)
    rules = spark.createDataFrame([row("B", 0, d(5), None), row("A", 1, d(0), d(5)), row("C", 2, d(0), d(4)), row("D", 3, None, None, "Inactive"), row("E", 4, d(9), d(8))], S.RULES)
    got = {(r["left_rule_id"], r["right_rule_id"]) for r in mapping.rule_conflicts(rules).collect()}
    assert got == {("B", "A"), ("A", "C")}


def test_as_of_equals_one_day_at_a_time(spark):
    root = "/root/testdata/sf0.001"
    m, rules, groups = Model.bind(spark, root), dated.rules(spark, root).cache(), dated.groups(spark, root)
    days = [dt.date(1996, 2, 14), dt.date(1997, 12, 31), dt.date(1999, 1, 1)]
    asked = m.products.select("product_id").crossJoin(spark.createDataFrame([(d,) for d in days], "as_of_date date"))
    got = sorted(map(tuple, mapping.resolve_as_of(asked, m.nodes(), rules, groups).collect()), key=str)
    want = [tuple(r) for d in days for r in mapping.resolve(m.nodes(), rules, groups, F.lit(d)).collect()]
    assert got == sorted(want, key=str) and len({r[16] for r in got}) == 5  # all states of resolution


def test_facts_of_one_product_on_two_days(spark):
    facts = binding.facts(spark, "/root/testdata/sf0.001", dated=True)
    made = mapping.resolve_as_of(facts, Model.bind(spark, "/root/testdata/sf0.001").nodes(), dated.rules(spark, "/root/testdata/sf0.001"), dated.groups(spark, "/root/testdata/sf0.001"), day="fact_date")
    rows = bridge.metric_bridge_as_of(facts, made)
    assert rows.columns == S.BRIDGE and rows.count() == facts.count()
    assert rows.groupBy("product_id").agg(F.countDistinct("winning_rule_id").alias("n")).where("n > 1").count() > 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
