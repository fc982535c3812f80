"""Sliced scans against brute force: any slice length, any partitioning, one hot key."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.operators.ordered import as_of_join, bucketed_steps, running_max_at, true_runs
from tarnwork.operators.series import counter_increase, value_changes
from tests.conftest import tuples

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def as_of_brute(spine, features, ttl):
    out = []
    for sid, key, t in spine:
        best = max(
            ((ft, tie, val) for fkey, ft, tie, val in features if fkey == key and key is not None and ft <= t),
            default=None,
        )
        if best is not None and ttl is not None and (t - best[0]).total_seconds() > ttl:
            best = None
        out.append((sid, best[2] if best else None))
    return sorted(out)


def as_of_spark(spark, spine, features, ttl, slice_seconds, parts=3):
    s = spark.createDataFrame(spine, "sid long, k string, t timestamp").repartition(parts)
    f = spark.createDataFrame(features, "k string, t timestamp, tie long, val string").repartition(parts)
    joined = as_of_join(
        s, f, ["k"], spine_time="t", feature_time="t", tiebreak=["tie"], payload=["val"],
        ttl_seconds=ttl, slice_seconds=slice_seconds,
    )
    return sorted(tuples(joined, "sid", "val"))


def make_as_of(seed, n=60):
    rnd = random.Random(seed)
    # Key "hot" has most of the rows.
    key = lambda: rnd.choice(["hot", "hot", "hot", "a", "b", None])
    spine = [(i, key(), at(rnd.randrange(2000))) for i in range(n)]
    spine += [(n + i, k, t) for i, (_, k, t) in enumerate(spine[:5])]  # repeated spine rows
    features = [(key(), at(rnd.randrange(2000)), rnd.randrange(3) * 1000 + i, f"v{i}") for i in range(n)]
    return spine, features


@pytest.mark.parametrize("slice_seconds", [1, 7, 100, 10_000])
@pytest.mark.parametrize("ttl", [None, 60])
def test_as_of_equals_brute_force(spark, slice_seconds, ttl):
    spine, features = make_as_of(slice_seconds)
    assert as_of_spark(spark, spine, features, ttl, slice_seconds) == as_of_brute(spine, features, ttl)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), slice_seconds=st.integers(1, 3000))
def test_as_of_random(spark, seed, slice_seconds):
    spine, features = make_as_of(seed, 25)
    assert as_of_spark(spark, spine, features, 200, slice_seconds) == as_of_brute(spine, features, 200)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_as_of_does_not_depend_on_partitioning(spark, parts):
    spine, features = make_as_of(1)
    assert as_of_spark(spark, spine, features, None, 50, parts) == as_of_brute(spine, features, None)


def test_as_of_without_features_keeps_the_spine(spark):
    spine, _ = make_as_of(2)
    got = as_of_spark(spark, spine, [], None, 50)
    assert got == sorted((sid, None) for sid, _, _ in spine)


def test_as_of_with_an_empty_spine(spark):
    _, features = make_as_of(2)
    assert as_of_spark(spark, [], features, None, 50) == []


def test_feature_at_the_same_time_counts_and_ties_go_to_the_greatest(spark):
    features = [("a", at(10), 1, "old"), ("a", at(10), 2, "new")]
    assert as_of_spark(spark, [(1, "a", at(10))], features, 0, 5) == [(1, "new")]


def test_running_maximum_is_not_the_latest(spark):
    facts = spark.createDataFrame([("a", at(0), 9), ("a", at(500), 3)], "k string, t timestamp, v int")
    probes = spark.createDataFrame([("a", at(600))], "k string, p timestamp")
    for seconds in (10, 10_000):
        got = running_max_at(
            facts, probes, ["k"], fact_time="t", probe_time="p", value=F.col("v"), out="m", slice_seconds=seconds
        )
        assert tuples(got, "m") == [(9,)]


def brute_increase(samples, bucket):
    out = {}
    last = {}
    for series, t, v in sorted(samples):
        start = int((t - T0).total_seconds()) // bucket * bucket
        step = 0.0
        if series in last:
            step = v if v < last[series] else v - last[series]
        last[series] = v
        out[(series, at(start))] = out.get((series, at(start)), 0.0) + step
    return sorted((s, b, x) for (s, b), x in out.items())


@pytest.mark.parametrize("bucket,slice_seconds", [(60, 300), (600, 300), (600, 60), (3600, 300)])
def test_counter_increase_equals_brute_force(spark, bucket, slice_seconds):
    rnd = random.Random(bucket)
    samples = []
    for series, n in (("hot", 200), ("cold", 12)):
        value = 0.0
        for t in sorted(rnd.sample(range(10_000), n)):
            value = 0.0 if rnd.random() < 0.05 else value + rnd.randrange(5)
            samples.append((series, at(t), value))
    df = spark.createDataFrame(samples, "s string, ts timestamp, value double").repartition(5)
    got = bucketed_steps(
        df, ["s"], time="ts", value="value", tiebreak=[], bucket_seconds=bucket, slice_seconds=slice_seconds,
        step=lambda p, c: F.when(c < p, c).otherwise(c - p), out="x",
    )
    assert sorted(tuples(got, "s", "bucket_start", "x")) == brute_increase(samples, bucket)


def test_counter_restart_counts_from_zero(spark):
    df = spark.createDataFrame([("a", at(0), 5.0), ("a", at(10), 8.0), ("a", at(70), 2.0)], "s string, ts timestamp, value double")
    got = sorted(tuples(counter_increase(df, ["s"], bucket_seconds=60), "bucket_start", "increase"))
    assert got == [(at(0), 3.0), (at(60), 2.0)]


def test_value_changes_across_buckets(spark):
    df = spark.createDataFrame(
        [("a", at(0), 1.0), ("a", at(10), 1.0), ("a", at(70), 2.0), ("a", at(80), 1.0)], "s string, ts timestamp, value double"
    )
    got = sorted(tuples(value_changes(df, ["s"], bucket_seconds=60), "bucket_start", "changes"))
    assert got == [(at(0), 0), (at(60), 2)]


def test_alert_needs_an_unbroken_run(spark):
    rows = [("a", at(60 * i), i not in (2, 8)) for i in range(12) if i != 5]
    df = spark.createDataFrame(rows, "l string, t timestamp, bad boolean")
    runs = true_runs(df, ["l"], time="t", condition=F.col("bad"), step_seconds=60, for_seconds=60)
    got = sorted(tuples(runs, "active_since", "firing_since", "last_true"))
    # 0-1, 3-4 (5 is missing), 6-7, 9-11
    assert got == [(at(60 * a), at(60 * a + 60), at(60 * b)) for a, b in ((0, 1), (3, 4), (6, 7), (9, 11))]
