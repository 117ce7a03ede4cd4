"""Tables larger than the given ones in one respect each: long fingerprints, product ids that several parts share."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlens import queries
from mixlens.functions import fingerprint
from mixlens.operators import bridge, validation
from mixlens.plans.refresh import Model
from mixlens.streaming import imports


def test_records_are_folded_in_blocks(spark):
    codes = np.arange(3 * fingerprint.BLOCK + 17) % 65536
    want = [0, 0]
    for c in codes.tolist():
        want = [(h * b + c) % m for h, (b, m) in zip(want, fingerprint.POLYNOMIALS, strict=True)]
    assert fingerprint.fold_codes(codes.astype(">u2"), fingerprint.fold_codes(codes[:0], [0, 0])) == want
    half = fingerprint.fold_codes(codes[:70000], [0, 0])
    assert fingerprint.fold_codes(codes[70000:], half) == want
    made = fingerprint.hash_records(spark.range(3).select(F.concat(F.lit("é😀"), F.col("id").cast("string")).alias("record")), "X-")
    assert made.first()[0] == "X-" + spark.sql("SELECT 'é😀0\né😀1\né😀2' AS x").select(fingerprint.hash_text("x")).first()[0]


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables with half the parts beyond a million, so that six digits of ten of them are one product id."""
    root = str(tmp_path_factory.mktemp("shared"))
    new = "CAST(CASE WHEN {0} % 2 = 0 THEN 100000 + {0} // 2 ELSE 1000000 + {0} END AS BIGINT) AS {0}".format
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        name = os.path.basename(f)[:-8]
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(name)
        con.execute(f"COPY (SELECT * {f'REPLACE ({new(key)})' if key else ''} FROM '{f}') TO '{root}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return root, con


@pytest.mark.parametrize(
    "name",
    ["bridge_as_of_shipping", "bridge_validation_errors", "cutover_totals_errors", "first_messages", "mapping_freshness_errors", "metric_qa", "metric_qa_of_faults", "node_catalogue", "reconciliation", "reconciliation_of_a_broken_bridge", "refreshed_bridge", "refreshed_results", "stored_mapping"],
)
def test_shared_product_ids(spark, shared, name):
    root, con = shared
    df = queries.queries()[name](spark, root)
    columns = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == collections.Counter(tuple(r[k] for k in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["result_qa", "result_qa_of_faults"])
def test_result_checks_of_shared_product_ids(spark, shared, name):
    test_shared_product_ids(spark, shared, name)


@pytest.fixture
def unbroadcast(spark):
    """Joins as on large tables: dimensions are shuffled."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def moved(spark, run):
    """Records each stage of ``run`` shuffled or wrote."""
    store = spark._jsc.sc().statusStore()
    stages = lambda: [s.apply(k) for s in [store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)] for k in range(s.size())]
    last = max((s.stageId() for s in stages()), default=-1)
    run()
    return [s.shuffleWriteRecords() + s.outputRecords() for s in stages() if s.stageId() > last]


@pytest.mark.parametrize("name", ["bridge_validation_errors", "first_messages"])
def test_bridge_checks_move_the_facts_once(spark, shared, unbroadcast, name):
    n = spark.read.parquet(f"{shared[0]}/lineitem.parquet").count()
    assert sum(moved(spark, lambda: queries.queries()[name](spark, shared[0]).collect())) < 6 * n  # to orders, suppliers and parts, then each side by id


@pytest.mark.parametrize("name", ["refreshed_bridge", "refreshed_results"])
def test_a_refresh_moves_no_row_of_the_bridge_twice(spark, shared, unbroadcast, name):
    n = spark.read.parquet(f"{shared[0]}/lineitem.parquet").count()
    run = lambda: queries.queries()[name](spark, shared[0]).write.format("noop").mode("overwrite").save()
    assert max(moved(spark, run)) <= n  # a fact of a shared id is written once, with copies


def test_facts_meet_dated_rules_without_multiplying(spark, shared, unbroadcast):
    n = spark.read.parquet(f"{shared[0]}/lineitem.parquet").count()
    run = lambda: queries.queries()["bridge_as_of_shipping"](spark, shared[0]).write.format("noop").mode("overwrite").save()
    assert max(moved(spark, run)) <= n


def test_counted_bridges_are_checked(spark, shared):
    m = Model.bind(spark, shared[0])
    rows, owed = m.counted_bridge().cache(), m.shared().cache()
    facts = m.facts.cache()
    again = lambda b: b.unionByName(b.limit(1))
    assert bridge.expanded(rows).exceptAll(m.bridge()).count() == 0 and m.bridge().exceptAll(bridge.expanded(rows)).count() == 0
    same = lambda b: validation.same_rows(facts, b, m.day, "", owed)
    assert same(rows) and same(bridge.expanded(rows))
    told = lambda b: {(r["check_id"], r["message"]) for r in validation.written_errors(facts, b, m.day, "", owed).collect()}
    assert told(rows) == set()
    for wrong, said in (
        (rows.limit(facts.count() - 1), ("bridge-fact", "missing")), (again(rows), ("bridge-duplicate", "duplicate key")),
        (rows.withColumn("copies", F.greatest(F.col("copies") - 1, F.lit(1))), ("bridge-fact", "missing")),
        (rows.withColumn("sales_amount", (F.col("sales_amount") + 1).cast("decimal(18,2)")), ("bridge-fact", "lineage differs")),
        (rows.withColumn("resolution_status", F.lit("Other")), ("bridge-state", "unsupported state")),
    ):
        assert not same(wrong) and said in told(wrong)


def test_stream_state_is_kept_on_disk(spark, shared, tmp_path):
    m, key = Model.bind(spark, shared[0]), next(iter(imports.STATE))
    facts = m.facts.limit(50).withColumn("arrived_at", F.right("sales_fact_id", F.lit(10)).cast("timestamp")).cache()
    facts.unionByName(facts).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get(key)
    q = imports.start(spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/in"), m.effective(), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.conf.get(key) == before and q.awaitTermination(120)
    assert any("rocksdb" in name for p in q.recentProgress for s in p["stateOperators"] for name in s["customMetrics"])


def test_streamed_bridge_of_shared_product_ids(spark, shared):
    test_shared_product_ids(spark, shared, "streamed_bridge")
