"""Keyed merges into stored tables, and the cube that follows superseded imports."""

import glob
import os
import random

import pytest

from mixlens.operators import merge, sinks
from mixlens.operators.validation import ValidationError
from mixlens.streaming import supersession

FIELDS = "id long, v string, p string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(k, f"v{k}", None if k % 10 == 9 else f"p {k % 5}/x") for k in range(100)], FIELDS).write.partitionBy("p").parquet(path)
    return path


def test_only_touched_partitions_are_written(spark, table):
    changes = spark.createDataFrame([(0, "new", "p 0/x", False), (1, "moved", "p 0/x", False), (2, "gone", "p 2/x", True), (500, "more", "brand new", False), (700, "never there", "p 3/x", True)], FIELDS + ", gone boolean")
    want = rows_of(sinks.upsert(spark.read.parquet(table), changes.drop("gone"), "id").where("id NOT IN (2, 700)"))
    before = files(table)
    names = merge.merge(changes, table, ["id"], "p", deleted=changes["gone"])
    assert rows_of(spark.read.parquet(table)) == want and len(names) == 4
    after, kept = files(table), {f for f in before if "p%203" in f or "p 3" in f or "p%204" in f or "p 4" in f or "HIVE" in f}
    assert len(kept) > 2 and all(after[f] == before[f] for f in kept)
    assert not set(after) & (set(before) - kept)
    assert glob.glob(f"{table}.*") == []
    assert merge.merge(changes.limit(0).drop("gone"), table, ["id"], "p") == []


def test_large_partitions_are_written_by_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(40_000).selectExpr("id", "sha2(CAST(id AS string), 512) AS v", "CASE WHEN id % 100 = 0 THEN concat('p', id % 5) ELSE 'hot' END AS p").repartition(6)
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        sinks.write_checked(rows, path, partition_by=("p",))
        count = lambda p: len(glob.glob(f"{path}/p={p}/*.parquet"))
        assert count("hot") > 3 and all(count(p) == 1 for p in ("p0",))
        merge.merge(spark.createDataFrame([(1, "new", "hot")], "id long, v string, p string"), path, ["id"], "p")
        assert count("hot") > 3 and spark.read.parquet(path).count() == 40_000
    finally:
        for k in sizes:
            spark.conf.unset(k)


def test_null_partition_and_an_emptied_one(spark, table):
    changes = spark.createDataFrame([(9, "x", None, False), *((k, "", "p 1/x", True) for k in range(1, 100, 5))], FIELDS + ", gone boolean")
    merge.merge(changes, table, ["id"], "p", deleted=changes["gone"])
    got = rows_of(spark.read.parquet(table))
    assert (9, "x", None) in got and not [r for r in got if r[0] % 5 == 1] and len(got) == 80


def test_wrong_changes_leave_the_table(spark, table):
    before, want = files(table), rows_of(spark.read.parquet(table))
    for bad in ([(1, "a", "p 0/x"), (1, "b", "p 0/x")], [(None, "a", "p 0/x")]):
        with pytest.raises(ValidationError):
            merge.merge(spark.createDataFrame(bad, FIELDS), table, ["id"], "p")
    with pytest.raises(ValidationError):
        merge.merge(spark.createDataFrame([(1, "a", "p 0/x")], FIELDS), table, ["id"], "p", check=lambda df: df.limit(1).selectExpr("'c' AS check_id", "'e' AS entity_id", "'m' AS message"))
    assert files(table) == before and rows_of(spark.read.parquet(table)) == want and glob.glob(f"{table}.*") == []


@pytest.mark.parametrize("at", [0, 1, 2, 3, 4])
def test_a_merge_that_fails_midway_is_finished(spark, table, monkeypatch, at):
    changes = spark.createDataFrame([(0, "new", "p 0/x"), (1, "moved", "p 2/x"), (500, "more", "brand new")], FIELDS)
    want = rows_of(sinks.upsert(spark.read.parquet(table), changes, "id"))
    real, calls = merge._rename, []

    def rename(*a):
        calls.append(a)
        if len(calls) == at + 1:
            raise OSError("lost")
        real(*a)

    monkeypatch.setattr(merge, "_rename", rename)
    with pytest.raises(OSError, match="lost"):
        merge.merge(changes, table, ["id"], "p")
    monkeypatch.setattr(merge, "_rename", real)
    assert merge.recover(spark, table) and rows_of(spark.read.parquet(table)) == want
    assert glob.glob(f"{table}.*") == [] and not merge.recover(spark, table)


def events(seed=4):
    own = random.Random(seed)
    batches, ids = [], 0
    for b in range(5):
        rows = []
        for _ in range(30):
            i = own.randrange(4)
            rows.append((f"I{i}", f"F{ids}", own.choice(["a", "b", None]), own.choice(["g", "h"]), own.randrange(1000), own.randrange(9), None, None))
            ids += 1
        if b:
            rows += own.sample([r for r in batches[0] if r[1]], 5) + rows[:3]  # repeats, late ones too
        batches.append(rows)
    state = lambda i, s, v: (f"I{i}", None, None, None, None, None, s, v)
    active, over = "Active Finalized", "Superseded"
    batches[0] += [state(0, active, 1), state(1, active, 1)]
    batches[1] += [state(0, over, 3), state(2, active, 1)]
    batches[2] += [state(0, active, 2), state(1, over, 2), state(1, over, 2)]  # version 2 of I0 comes late: it stays superseded
    batches[3] += [state(1, active, 3), state(2, over, 2)]
    return batches  # I3 is never published


def as_frame(spark, rows):
    return spark.createDataFrame([(*r[:4], r[4], r[5], *r[6:]) for r in rows], supersession.EVENTS.replace("decimal(18,2)", "long")).selectExpr("import_id", "sales_fact_id", "reporting_channel", "reporting_group_id", "CAST(sales_amount AS decimal(18,2)) AS sales_amount", "CAST(quantity AS decimal(18,2)) AS quantity", "publication_state", "version")


def test_cube_equals_the_recomputed_one_after_every_batch(spark, tmp_path):
    batches, path = events(), f"{tmp_path}/cube"
    for k, rows in enumerate(batches):
        supersession.apply(as_frame(spark, rows), k, path)
        want = rows_of(supersession.recomputed(as_frame(spark, [r for b in batches[: k + 1] for r in b])))
        assert rows_of(supersession.cube(spark, path)) == want
    supersession.apply(as_frame(spark, batches[-1]), len(batches) - 1, path)  # a batch delivered again
    assert rows_of(supersession.cube(spark, path)) == want
    assert {r[0] for r in want} == {"I1"}


def test_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    batches, path = events(9), f"{tmp_path}/cube"
    for k, rows in enumerate(batches):
        supersession.apply(as_frame(spark, rows), k, path)
        if k == 2:
            with monkeypatch.context() as m:  # lost before the new base counts
                m.setattr(supersession, "_mark", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    supersession.compact(spark, path, k)
        elif k:
            assert supersession.compact(spark, path, k)
            supersession.apply(as_frame(spark, rows), k, path)  # the batch behind the base is delivered again
        want = rows_of(supersession.recomputed(as_frame(spark, [r for b in batches[: k + 1] for r in b])))
        assert rows_of(supersession.cube(spark, path)) == want
    assert supersession.compacted(spark, path) == 4 and os.listdir(f"{path}/base") == ["upto=4"] and os.listdir(f"{path}/seen") == ["batch_id=4"]
    os.makedirs(f"{path}/sums/batch_id=1")  # left over by a deletion that failed
    assert supersession.compact(spark, path, 4) and not supersession.compact(spark, path, 4)
    assert want and rows_of(supersession.cube(spark, path)) == want


def test_cube_of_a_stream(spark, tmp_path):
    batches, path = events(6), f"{tmp_path}/cube"
    for part in (batches[:2], batches[2:]):  # a second run goes on from the checkpoint
        for rows in part:
            as_frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(supersession.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        supersession.start(stream, path, f"{tmp_path}/checkpoint", compact_every=2).awaitTermination()
        done = [r for b in (batches[:2] if part is not batches[2:] and len(part) == 2 else batches) for r in b]
        assert rows_of(supersession.cube(spark, path)) == rows_of(supersession.recomputed(as_frame(spark, done)))
