"""A key with most of the rows: joins are split, windows stay small."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import keyed
from tarnwork.operators.ordered import as_of_join
from tarnwork.plans import access, approvals, features, membership, ml
from tarnwork.session import scratch_path

ROWS = 400_000


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def small_partitions(spark):
    """Skew limits in proportion to the test rows, no broadcasts."""
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.shuffle.partitions": "32",
        },
    ):
        yield


@pytest.fixture(scope="module")
def hot_requests(spark):
    """Requests of which half are from one applicant."""
    path = scratch_path(spark, "hot")
    number = F.col("id")
    spark.range(ROWS, numPartitions=8).select(
        "id",
        F.when(number % 2 == 0, F.lit("u7")).otherwise(F.concat(F.lit("u"), (number % 5000).cast("string"))).alias("username"),
        F.concat(F.lit("demo.t"), (number % 50).cast("string")).alias("table_fqn"),
        (1 + number % 3).cast("int").alias("security_level"),
        F.md5(number.cast("string")).alias("table_owner"),
        F.timestamp_seconds(F.lit(1_700_000_000) + number * 60).alias("ts"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def staff(spark):
    number = F.col("id")
    return spark.range(5000).select(
        "id",
        F.concat(F.lit("E"), number.cast("string")).alias("employee_id"),
        F.concat(F.lit("u"), number.cast("string")).alias("username"),
        F.concat(F.lit("E"), F.expr("CAST(id DIV 10 AS STRING)")).alias("manager_id"),
        F.lit("n").alias("name"),
    )


def final_plan(spark, df):
    """Plan text after AQE, from a run of exactly this frame."""
    df.toLocalIterator(prefetchPartitions=False).__next__()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot_steps(rows):
    """Half of all steps are of one request."""
    return rows.select(
        "id",
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("long").alias("request_id"),
        F.col("security_level").alias("step_order"),
        F.col("table_owner").alias("approver_username"),
        F.when(F.col("id") % 3 == 0, F.lit("approved")).when(F.col("id") % 5000 == 4, F.lit("rejected")).otherwise(F.lit("pending")).alias("status"),
        F.when(F.col("id") % 7 == 0, F.col("ts")).alias("activated_at"),
    )


JOBS = {
    "chain": lambda r, staff: approvals.approval_chain(r, staff),
    "admission": lambda r, staff: approvals.admit_requests(r, staff),
    "codes": lambda r, staff: ml.encode_labels(r.select("username", "table_owner", "id"), "username", "code"),
    "expiry": lambda r, staff: access.with_grant(
        r.withColumnRenamed("username", "user").withColumn(
            "table_fqn", F.when(F.col("id") % 2 == 0, F.lit("demo.t1")).otherwise(F.col("table_fqn"))
        ),
        staff.select(
            "username",
            F.concat(F.lit("demo.t"), (F.col("id") % 50).cast("string")).alias("table_fqn"),
            F.lit("").alias("expires_at"),
            F.lit("2020-01-01").alias("granted_at"),
        ),
        respect_granted_at=False,
    ),
    "members": lambda r, staff: membership.members(
        r.select(F.col("table_owner").alias("username"), F.col("username").alias("group"))
    ),
    "known groups": lambda r, staff: keyed.rows_in(r, r.select("username"), ["username"]),
    "online lookup": lambda r, staff: features.online_lookup(
        r.select("username", "id"),
        features.materialize(r.select("username", "ts", "id", "table_owner"), ONLINE, "2000-01-01", "2100-01-01"),
        ONLINE,
    ),
    "work list": lambda r, staff: approvals.work_list(hot_steps(r), r.where("id < 5000")),
    "rejection": lambda r, staff: approvals.skip_after_reject(hot_steps(r)),
    "activation": lambda r, staff: approvals.activate_steps(hot_steps(r), "2026-01-01"),
    "hand-over": lambda r, staff: approvals.transfer_steps(
        hot_steps(r.withColumn("table_owner", F.col("username"))), staff.select(F.col("username").alias("from_user"), F.lit("v").alias("to_user"))
    ),
    "listing": lambda r, staff: approvals.requests_with_steps(r.where("id < 5000"), hot_steps(r)),
}
ONLINE = features.FeatureView("v", ("username",), ("table_owner",), time="ts", tiebreak=("id",))


@pytest.mark.parametrize("job", sorted(JOBS))
def test_hot_key_is_split_by_the_join(spark, small_partitions, hot_requests, staff, job):
    assert "skew=true" in final_plan(spark, JOBS[job](hot_requests, staff))


def test_as_of_groups_stay_small(spark, hot_requests):
    """The rows of the hot key are spread over its slices: no window group has more than one slice of them."""
    from tarnwork.functions.times import slice_of

    day = 86_400
    sizes = hot_requests.groupBy("username", slice_of(F.col("ts"), day)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 24 * 60
    assert hot_requests.groupBy("username").count().agg(F.max("count")).first()[0] >= ROWS // 2
    joined = as_of_join(
        hot_requests.select("id", "username", "ts"),
        hot_requests.select("username", "ts", F.col("id").alias("fid")),
        ["username"], spine_time="ts", feature_time="ts", tiebreak=["fid"], payload=["fid"], slice_seconds=day,
    )
    assert joined.where(~F.col("id").eqNullSafe(F.col("fid"))).count() == 0


def test_default_slices_split_a_burst_and_leave_null_keys_out(spark):
    """Half of the rows are of one key within one hour, a quarter has no key; nothing is set by hand."""
    import inspect

    from tarnwork.functions.times import slice_of
    from tarnwork.operators.ordered import MINUTE
    from tarnwork.plans import access, features
    from tarnwork.session import cut_lineage

    for function in (as_of_join, access.with_grant, access.access_decisions, features.historical_features):
        assert inspect.signature(function).parameters["slice_seconds"].default == MINUTE
    n = 8000
    rows = spark.range(n).select(
        "id",
        F.when(F.col("id") < n // 2, "hot").when(F.col("id") < 3 * n // 4, F.concat(F.lit("k"), F.col("id") % 50)).alias("username"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") < n // 2, F.col("id") % 3600).otherwise(F.col("id") * 60)).alias("ts"),
    )
    rows = cut_lineage(rows)
    groups = rows.where("username is not null").groupBy("username", slice_of(F.col("ts"), MINUTE)).count()
    assert groups.agg(F.max("count")).first()[0] <= n // 2 // 60 * 2
    joined = as_of_join(
        rows, rows.select("username", "ts", F.col("id").alias("fid")),
        ["username"], spine_time="ts", feature_time="ts", tiebreak=["fid"], payload=["fid"],
    )
    assert joined.count() == n
    assert joined.where("username is null and fid is not null").count() == 0
    assert joined.where("username is not null and fid is null").count() == 0
    # The rows without a key are spread by their hash.
    assert "pmod(xxhash64(id" in joined._jdf.queryExecution().optimizedPlan().toString()
