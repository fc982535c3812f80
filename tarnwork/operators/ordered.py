"""Ordered per-key scans that hold up when one key has most of the rows.

A window over (key) puts all rows of a key into one task.  The operators here
window over (key, time slice) and hand the state at the end of a slice on to
the next one in a second pass, which sees one row per (key, slice).  The size
of a group is then bound by what arrives within one slice, and the second pass
by the number of slices in the covered time, whatever the key distribution is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.times import slice_of

DAY = 86_400
MINUTE = 60

# Order within a slice: facts, then probes of the same time (a probe sees facts of its own time).
# Probes without a key or a time are dealt out to so many slices.
_FACT, _PROBE, _UNKEYED = 1, 2, 3
_SPREAD = 1024


def running_max_at(
    facts: DataFrame,
    probes: DataFrame,
    keys: list[str],
    *,
    fact_time: str,
    probe_time: str,
    value: Column,
    out: str,
    slice_seconds: int = MINUTE,
) -> DataFrame:
    """For every probe row the greatest ``value`` of facts with time <= probe time.

    ``value`` is an expression over ``facts`` of any orderable type; a struct
    which starts with the fact time makes this "the latest fact".  Probes keep
    all their columns and their number; ``out`` is null where no fact applies.
    No (fact, probe) pair is ever built.

    Slices are short by default, so a burst of one key is spread over its
    minutes; the pass over the slices of a key is bound by the covered time.
    Facts and probes are read once and cross one exchange; the state that slices
    hand on is made of the same shuffled rows.  Probes without a key or a time
    can meet no fact and are spread by their hash.
    """
    keyed = F.lit(True)
    for name in (*keys, probe_time):
        keyed = keyed & F.col(name).isNotNull()
    # The key as a struct is never null itself, so no condition on it is inferred
    # for one use of the rows below and not for the other.
    key = F.struct(*keys).alias("__key")
    fact_rows = facts.dropna(subset=[*keys, fact_time]).select(
        key,
        F.col(fact_time).alias("__at"),
        slice_of(F.col(fact_time), slice_seconds).alias("__slice"),
        F.lit(_FACT).alias("__phase"),
        value.alias("__value"),
    )
    spread = F.pmod(F.xxhash64(*(f.name for f in probes.schema.fields if f.dataType.typeName() != "map")), F.lit(_SPREAD))
    probe_rows = probes.select(
        key,
        F.col(probe_time).alias("__at"),
        F.coalesce(F.when(keyed, slice_of(F.col(probe_time), slice_seconds)), spread).alias("__slice"),
        F.when(keyed, _PROBE).otherwise(_UNKEYED).alias("__phase"),
        F.struct(*probes.columns).alias("__row"),
    )
    group = ["__key", "__slice"]

    # The one exchange of the rows.  The count below never counts, but names
    # every column: both uses of the rows ask for the same ones, so the exchange
    # is made once and read twice.
    rows = fact_rows.unionByName(probe_rows, allowMissingColumns=True).repartition(*group)
    nothing = F.count(F.when(F.col("__phase") < 0, F.struct(*rows.columns))).alias("__nothing")

    # One row per (key, slice): best value of the slice, null for slices with probes only.
    per_slice = rows.groupBy(*group).agg(F.max("__value").alias("__best"), nothing).where("__nothing = 0")
    earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*group, F.max("__best").over(earlier).alias("__carried"))

    so_far = (
        Window.partitionBy(*group).orderBy("__at", "__phase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(carried, group, "left")
        .withColumn("__best", F.greatest("__carried", F.max("__value").over(so_far)))
        .where(F.col("__phase") != _FACT)
        .select("__row.*", F.when(F.col("__phase") == _PROBE, F.col("__best")).alias(out))
    )


def as_of_join(
    spine: DataFrame,
    features: DataFrame,
    keys: list[str],
    *,
    spine_time: str,
    feature_time: str,
    tiebreak: list[str],
    payload: list[str],
    ttl_seconds: int | None = None,
    slice_seconds: int = MINUTE,
) -> DataFrame:
    """Point-in-time join: per spine row the latest feature row at its time.

    Ties on the feature time go to the greatest ``tiebreak``.  A feature older
    than the time-to-live, or no feature at all, gives null payload columns;
    every spine row survives, duplicates included.
    """
    hit = F.struct(
        F.col(feature_time).alias("at"),
        F.struct(*tiebreak).alias("tie"),
        F.struct(*payload).alias("payload"),
    )
    joined = running_max_at(
        features,
        spine,
        keys,
        fact_time=feature_time,
        probe_time=spine_time,
        value=hit,
        out="__hit",
        slice_seconds=slice_seconds,
    )
    alive = F.lit(True)
    if ttl_seconds is not None:
        age = F.unix_micros(F.col(spine_time)) - F.unix_micros(F.col("__hit.at"))
        alive = age <= F.lit(ttl_seconds * 1_000_000)
    return joined.select(
        *spine.columns, *[F.when(alive, F.col(f"__hit.payload.{c}")).alias(c) for c in payload]
    )


def bucketed_steps(
    samples: DataFrame,
    series: list[str],
    *,
    time: str,
    value: str,
    tiebreak: list[str],
    bucket_seconds: int,
    step: Callable[[Column, Column], Column],
    out: str,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Sum of ``step(previous, current)`` over neighbouring samples, per bucket.

    A step belongs to the bucket of its later sample; the first sample of a
    series adds nothing.  Steps inside a slice come from a window over
    (series, slice), the step into a slice from the last sample of the slice
    before, so the second window sees one row per (series, slice).  A slice
    is the greatest common part of ``slice_seconds`` and the bucket, so long or
    odd buckets do not make long groups.
    """
    slice_seconds = math.gcd(slice_seconds, bucket_seconds)
    group = [*series, "__slice"]
    order = [time, *tiebreak]
    rows = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        *series, *order, F.col(value).alias("__v"), slice_of(F.col(time), slice_seconds).alias("__slice")
    )
    within = Window.partitionBy(*group).orderBy(*order)
    stamp = F.struct(*order)
    # Same clustering as the window: this aggregate adds no exchange.
    per_slice = (
        rows.withColumn("__step", step(F.lag("__v").over(within), F.col("__v")))
        .groupBy(*group)
        .agg(
            F.coalesce(F.sum("__step"), F.lit(0.0)).alias("__inside"),
            F.min_by("__v", stamp).alias("__first"),
            F.max_by("__v", stamp).alias("__last"),
        )
    )
    across = Window.partitionBy(*series).orderBy("__slice")
    entry = F.coalesce(step(F.lag("__last").over(across), F.col("__first")), F.lit(0.0))
    bucket = F.col("__slice") - F.pmod(F.col("__slice"), F.lit(bucket_seconds * 1_000_000))
    stepped = per_slice.select(
        *series, F.timestamp_micros(bucket).alias("bucket_start"), (F.col("__inside") + entry).alias(out)
    )
    if slice_seconds == bucket_seconds:
        return stepped
    # The window has clustered the rows by series already: again no exchange.
    return stepped.groupBy(*series, "bucket_start").agg(F.sum(out).alias(out))


def true_runs(
    evaluated: DataFrame,
    labels: list[str],
    *,
    time: str,
    condition: Column,
    step_seconds: int,
    for_seconds: int,
) -> DataFrame:
    """Runs in which a condition held at every evaluation for long enough.

    ``evaluated`` has at most one row per (labels, evaluation time), so a
    window over the labels is bound by the number of evaluations in the
    covered time.  A missing evaluation ends a run.
    """
    held = evaluated.where(condition).select(*labels, F.col(time).alias("__at"))
    rank = F.row_number().over(Window.partitionBy(*labels).orderBy("__at"))
    island = F.unix_micros("__at") - rank.cast("long") * F.lit(step_seconds * 1_000_000)
    return (
        held.withColumn("__island", island)
        .groupBy(*labels, "__island")
        .agg(F.min("__at").alias("active_since"), F.max("__at").alias("last_true"))
        .where(
            F.unix_micros("last_true") - F.unix_micros("active_since") >= F.lit(for_seconds * 1_000_000)
        )
        .select(
            *labels,
            "active_since",
            F.timestamp_micros(F.unix_micros("active_since") + F.lit(for_seconds * 1_000_000)).alias("firing_since"),
            "last_true",
        )
    )


def held_sessions(
    evaluated: DataFrame, labels: list[str], *, window: str, condition: Column, step_seconds: int, for_seconds: int
) -> DataFrame:
    """``true_runs`` in a form that works on streams as well: a run is a session of true evaluations.

    ``evaluated`` has one row per (labels, evaluation), with the evaluation as a
    window column of ``step_seconds``.  A session goes on while the next true
    evaluation follows at the next step; half a step more is the gap, so a
    missing evaluation ends it.  On a stream a run appears once, when the
    watermark has passed its end and the gap; only open runs are kept as state.
    """
    step, gap = step_seconds * 1_000_000, step_seconds * 1_500_000
    held = evaluated.where(condition).withColumn("__at", F.window_time(window))
    # A condition on the session itself would be pushed below the merging of sessions, so its ends are aggregates.
    runs = held.groupBy(*labels, F.session_window("__at", f"{gap} microseconds").alias("__s")).agg(
        F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.count(F.lit(1)).alias("evaluations")
    )
    # A window's time is its end minus one microsecond.
    first, last = (F.unix_micros(c) + 1 - step for c in ("__first", "__last"))
    return runs.where(last - first >= F.lit(for_seconds * 1_000_000)).select(
        *labels,
        F.timestamp_micros(first).alias("active_since"),
        F.timestamp_micros(first + F.lit(for_seconds * 1_000_000)).alias("firing_since"),
        F.timestamp_micros(last).alias("last_true"),
        "evaluations",
    )
