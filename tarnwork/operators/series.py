"""Metric series: counters, histograms, label joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.keyed import lookup_join, rows_in
from tarnwork.operators.ordered import bucketed_steps

INF = float("inf")


def counter_increase(
    samples: DataFrame,
    series: list[str],
    *,
    time: str = "ts",
    value: str = "value",
    tiebreak: list[str] | None = None,
    bucket_seconds: int,
    out: str = "increase",
) -> DataFrame:
    """Growth of a counter per (series, bucket); a drop counts as a restart at 0."""
    return bucketed_steps(
        samples,
        series,
        time=time,
        value=value,
        tiebreak=tiebreak or [],
        bucket_seconds=bucket_seconds,
        step=lambda prev, cur: F.when(cur < prev, cur).otherwise(cur - prev).cast("double"),
        out=out,
    )


def counter_rate(samples: DataFrame, series: list[str], *, bucket_seconds: int, out: str = "rate", **kw) -> DataFrame:
    """Per-second growth of a counter per (series, bucket)."""
    grown = counter_increase(samples, series, bucket_seconds=bucket_seconds, out="__inc", **kw)
    return grown.select(*series, "bucket_start", (F.col("__inc") / F.lit(float(bucket_seconds))).alias(out))


def value_changes(
    samples: DataFrame,
    series: list[str],
    *,
    time: str = "ts",
    value: str = "value",
    tiebreak: list[str] | None = None,
    bucket_seconds: int,
) -> DataFrame:
    """Number of value changes per (series, bucket)."""
    counted = bucketed_steps(
        samples,
        series,
        time=time,
        value=value,
        tiebreak=tiebreak or [],
        bucket_seconds=bucket_seconds,
        step=lambda prev, cur: F.when(cur != prev, F.lit(1.0)).otherwise(F.lit(0.0)),
        out="__n",
    )
    return counted.select(*series, "bucket_start", F.col("__n").cast("long").alias("changes"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null where the denominator is 0."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def cumulative_buckets(observations: DataFrame, labels: list[str], *, value: str, bounds: list[float]) -> DataFrame:
    """(labels, le, count) with cumulative counts, one pass over the observations.

    One conditional count per bound and row group, then a row per bound; the
    observations themselves are not multiplied.
    """
    limits = sorted(bounds) + [INF]
    counts = observations.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= F.lit(b)).alias(f"__le{i}") for i, b in enumerate(limits)]
    )
    pairs = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"__le{i}").cast("double").alias("count")) for i, b in enumerate(limits)]
    )
    return counts.select(*labels, F.inline(pairs))


def histogram_quantile(buckets: DataFrame, labels: list[str], q: float, *, le: str = "le", count: str = "count", out: str = "quantile") -> DataFrame:
    """Quantile of cumulative histograms by linear interpolation.

    The window runs over the bounds of one histogram, whose number is the
    fixed bucket layout.  Null when nothing was counted or no +Inf bound exists.
    """
    return histogram_quantiles(buckets, labels, {out: q}, le=le, count=count)


def histogram_quantiles(
    buckets: DataFrame, labels: list[str], quantiles: dict[str, float], *, le: str = "le", count: str = "count", monotone: bool = False
) -> DataFrame:
    """Several quantiles of the same histograms, each a column, from one pass.

    ``monotone`` raises a bound's count to the greatest one of smaller bounds:
    rates of bucket counters that were reset or read at different times need not
    grow with the bound.
    """
    by_bound = Window.partitionBy(*labels).orderBy(le)
    whole = Window.partitionBy(*labels)
    summed = buckets.groupBy(*labels, le).agg(F.sum(count).alias("__c"))
    if monotone:
        so_far = by_bound.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = summed.withColumn("__c", F.max("__c").over(so_far))
    rows = summed.select(
        *labels,
        F.col(le).alias("__le"),
        "__c",
        F.lag(le).over(by_bound).alias("__lo"),
        F.lag("__c").over(by_bound).alias("__c0"),
        F.max(F.when(F.col(le) == INF, F.col("__c"))).over(whole).alias("__total"),
    )
    first = F.col("__lo").isNull()
    lower = F.when(first, F.lit(0.0)).otherwise(F.col("__lo"))
    below = F.coalesce(F.col("__c0"), F.lit(0.0))

    def at_bound(rank: Column) -> Column:
        inside = lower + (F.col("__le") - lower) * (rank - below) / F.nullif(F.col("__c") - below, F.lit(0.0))
        return (
            F.when(F.col("__total") <= 0, F.lit(None).cast("double"))
            .when(F.col("__le") == INF, F.col("__lo"))
            .when(first & (F.col("__le") <= 0), F.col("__le"))
            .otherwise(inside)
        )

    ranks = {out: F.col("__total") * F.lit(q) for out, q in quantiles.items()}
    return rows.groupBy(*labels).agg(
        *[F.min_by(at_bound(rank), F.when(F.col("__c") >= rank, F.col("__le"))).alias(out) for out, rank in ranks.items()]
    )


def many_to_one(many: DataFrame, one: DataFrame, on: list[str], value: Column, out: str = "value") -> DataFrame:
    """Series arithmetic that keeps the labels of the many side.

    ``one`` must have one row per ``on``; a second one is an error, as it would
    multiply rows.
    """
    unique = one.groupBy(*on).agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("many-to-many matching of series")).cast("double"))
        .otherwise(F.max("value"))
        .alias("__one")
    )
    return lookup_join(many, unique, on, "inner").withColumn(out, value).drop("__one")


def keep_if_present(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left and on(..) right``: rows of left whose labels occur in right."""
    return rows_in(left, right, on)


def difference_or_default(left: DataFrame, right: DataFrame, on: list[str], *, value: str, default: float = 0.0, out: str) -> DataFrame:
    """``left - right`` per label set; a missing right side counts as ``default``."""
    other = right.select(*on, F.col(value).alias("__other"))
    return left.join(other, on, "left").select(
        *on, (F.col(value) - F.coalesce(F.col("__other"), F.lit(default))).alias(out)
    )
