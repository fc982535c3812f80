"""Bucketed snapshots: what an upsert moves and writes, against a full reduction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.session import scratch_path
from tarnwork.sinks.snapshots import PART, BucketedSnapshot
from tests.conftest import tuples

SCHEMA = "k string, n int, t int, v long"


def store(spark, buckets=8):
    schema = spark.createDataFrame([], SCHEMA).schema
    return BucketedSnapshot(spark, scratch_path(spark, "snapshot"), schema, ("k", "n"), ("t", "v"), buckets)


def reduced(rows):
    best = {}
    for k, n, t, v in rows:
        if k is not None and n is not None:
            best[k, n] = max(best.get((k, n), (t, v)), (t, v))
    return sorted((*key, *value) for key, value in best.items())


@pytest.mark.parametrize("seed", range(2))
def test_upserts_equal_a_full_reduction(spark, seed):
    order = random.Random(seed)
    own, every = store(spark), []
    for part in range(4):
        rows = [(f"k{order.randrange(40)}", order.randrange(2), order.randrange(9), order.randrange(99)) for _ in range(60 if part < 3 else 0)]
        rows += [(None, 1, 1, 1), ("x", None, 1, 1)]
        every += rows
        own.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert sorted(tuples(own.read())) == reduced(every)
    before = own.versions()
    own.upsert(spark.createDataFrame(rows, SCHEMA))  # nothing with a key: no new version
    assert own.versions() == before and len(before) == 3
    assert sorted(tuples(own.read(before[0]))) == reduced(every[:62])


def test_only_touched_buckets_are_written(spark):
    own = store(spark)
    own.publish(spark.createDataFrame([(f"k{i}", 0, 1, i) for i in range(500)], SCHEMA))
    change = spark.createDataFrame([("k3", 0, 2, -1)], SCHEMA)
    own.upsert(change)
    first, second = (sorted(d for d in os.listdir(own.root) if d.startswith("rows-")))
    written = [d for d in os.listdir(f"{own.root}/{second}") if d.startswith(PART)]
    assert len([d for d in os.listdir(f"{own.root}/{first}") if d.startswith(PART)]) == 8 and len(written) == 1
    again = own.upsert(change)  # the same rows once more
    assert sorted(tuples(own.read(again))) == sorted(tuples(own.read(2))) and own.read().count() == 500
    assert tuples(own.read().where("k = 'k3'")) == [("k3", 0, 2, -1)]


def test_stored_rows_are_not_shuffled(spark):
    own = store(spark)
    own.publish(spark.createDataFrame([(f"k{i}", 0, 1, i) for i in range(500)], SCHEMA))
    plan = own.merge(spark.createDataFrame([("k3", 0, 2, -1)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Bucketed: true" in plan
    old_side = plan[plan.index("SortMergeJoin") : plan.index("Exchange hash")]
    assert "FileScan" in old_side
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        wanted = spark.createDataFrame([("k3", 0), ("zz", 1)], "k string, n int")
        looked_up = wanted.join(own.read(), ["k", "n"], "left")
        assert looked_up._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
        assert sorted(tuples(looked_up), key=str) == [("k3", 0, 1, 3), ("zz", 1, None, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)


def test_few_keys_leave_buckets_empty(spark):
    own = store(spark, 32)
    with pytest.raises(FileNotFoundError):
        own.read()
    own.publish(spark.createDataFrame([], SCHEMA))
    assert own.read().count() == 0
    own.upsert(spark.createDataFrame([("a", 1, 1, 1)], SCHEMA))
    own.upsert(spark.createDataFrame([("b", 1, 1, 1), ("a", 1, 0, 9)], SCHEMA))
    assert sorted(tuples(own.read())) == [("a", 1, 1, 1), ("b", 1, 1, 1)]


def test_a_version_without_a_manifest_is_not_seen(spark):
    own = store(spark)
    own.publish(spark.createDataFrame([("a", 1, 1, 1)], SCHEMA))

    class Broken(BucketedSnapshot):
        def _listed(self, version):
            raise RuntimeError("lost")

    broken = Broken(own.spark, own.root, own.schema, own.keys, own.order, own.buckets)
    with pytest.raises(RuntimeError):
        broken.upsert(spark.createDataFrame([("a", 1, 2, 2)], SCHEMA))
    assert own.versions() == [1] and tuples(own.read()) == [("a", 1, 1, 1)]
    own.upsert(spark.createDataFrame([("a", 1, 2, 2)], SCHEMA))
    assert tuples(own.read().select("k", F.col("t"))) == [("a", 2)]
