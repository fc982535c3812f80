"""Log and metric queries: counts, rates, quantiles, ratios and alert conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.labels import label_not_matches, label_replace, line_contains, line_matches, logfmt_value
from tarnwork.functions.times import bucket_start
from tarnwork.operators.ordered import held_sessions, true_runs
from tarnwork.operators.series import (
    counter_increase,
    difference_or_default,
    histogram_quantile,
    histogram_quantiles,
    keep_if_present,
    many_to_one,
    ratio,
)

# ---- fixed values: label levels, patterns and thresholds of the rules ------
RULE_LEVELS = {
    "job": ("job",),
    "job_route": ("job", "route"),
    "namespace_job_route": ("namespace", "job", "route"),
}
RULE_LABELS = ("namespace", "job", "route")
CREDENTIALS = r"http(s?)://(\w+):(\w+)@"
SERVER_ERROR = "5.."
STATUS_CLASS = ("${1}xx", "([0-9])..")
STATUS_WORD = ("${1}", "([a-z]+)")
ERROR_PERCENT, ERROR_LOOKBACK, ERROR_FOR = 10.0, 120, 900
PANIC_LOOKBACK = 600
LATENCY_SECONDS, LATENCY_FOR, LATENCY_ROUTE_EXCLUDED = 1.0, 900, "(?i).*tail.*"
LOG_ERROR_RATIO = 0.05
SINGLETON_LIMIT, SINGLETON_FOR = 1.0, 300
CANARY_SECONDS, CANARY_FOR, CANARY_LABELS = 5.0, 900, ("namespace", "job")
# ---------------------------------------------------------------------------


# -- log lines ---------------------------------------------------------------


def lines_with(logs: DataFrame, text: str, **labels: str) -> DataFrame:
    """Raw lines of a label selection that contain a text."""
    return _selected(logs, labels).where(line_contains(F.col("line"), text))


def count_over_time(logs: DataFrame, seconds: int, by: list[str] | None = None, text: str | None = None, **labels: str) -> DataFrame:
    """Number of (matching) lines per interval."""
    rows = _selected(logs, labels)
    if text is not None:
        rows = rows.where(line_contains(F.col("line"), text))
    return rows.groupBy(bucket_start(F.col("ts"), seconds).alias("bucket_start"), *(by or [])).agg(
        F.count(F.lit(1)).alias("line_count")
    )


def log_rate(logs: DataFrame, seconds: int, by: list[str], **labels: str) -> DataFrame:
    counted = count_over_time(logs, seconds, by, **labels)
    return counted.select("bucket_start", *by, ratio(F.col("line_count"), F.lit(seconds)).alias("rate"))


def log_rate_by_level(logs: DataFrame, seconds: int = 300, text: str = "", **labels: str) -> DataFrame:
    """Lines per second by the ``level`` field of ``key=value`` lines."""
    parsed = logs.withColumn("level", logfmt_value(F.col("line"), "level"))
    if text:
        parsed = parsed.where(line_contains(F.col("line"), text))
    return log_rate(parsed, seconds, ["level"], **labels)


def credential_leaks(logs: DataFrame, by: list[str], seconds: int = 300) -> DataFrame:
    """Intervals in which lines carry a password within an address."""
    return count_over_time(logs.where(line_matches(F.col("line"), CREDENTIALS)), seconds, by)


def error_line_ratio(logs: DataFrame, by: list[str], seconds: int = 300, text: str = "error", threshold: float | None = LOG_ERROR_RATIO) -> DataFrame:
    """Share of lines that contain a text, per interval; above the threshold only."""
    shares = logs.groupBy(bucket_start(F.col("ts"), seconds).alias("bucket_start"), *by).agg(
        F.count_if(line_contains(F.col("line"), text)).alias("__bad"), F.count(F.lit(1)).alias("__all")
    )
    out = shares.select("bucket_start", *by, ratio(F.col("__bad"), F.col("__all")).alias("error_ratio"))
    return out if threshold is None else out.where(F.col("error_ratio") > threshold)


def _selected(logs: DataFrame, labels: dict[str, str]) -> DataFrame:
    for name, value in labels.items():
        logs = logs.where(F.col(name) == value)
    return logs


# -- metric series -----------------------------------------------------------


def rolled_up(base: DataFrame, measures: dict[str, Column], extra: list[str]) -> DataFrame:
    """The three label levels of the recording rules from one aggregate.

    ``base`` already is one row per (namespace, job, route, extra), so the
    expansion into grouping sets works on aggregates and not on samples.
    Labels a level leaves out are null.
    """
    sets = [[*labels, *extra] for labels in RULE_LEVELS.values()]
    left_out = lambda label: F.grouping(label) == 1
    level = (
        F.when(left_out("route"), F.lit("job"))
        .when(left_out("namespace"), F.lit("job_route"))
        .otherwise(F.lit("namespace_job_route"))
    )
    summed = base.groupingSets(sets, *RULE_LABELS, *extra).agg(
        level.alias("level"), *[agg.alias(name) for name, agg in measures.items()]
    )
    return summed.select("level", *RULE_LABELS, *extra, *measures)


def rate_sums(samples: DataFrame, series: list[str], seconds: int = 60) -> DataFrame:
    """Summed counter rates on the three label levels.

    Growth is summed and divided once at the end, which is the sum of the rates.
    """
    grown = counter_increase(samples, series, bucket_seconds=seconds, tiebreak=["tie"])
    base = grown.groupBy(*RULE_LABELS, "bucket_start").agg(F.sum("increase").alias("__inc"))
    levels = rolled_up(base, {"__inc": F.sum("__inc")}, ["bucket_start"])
    return levels.select(
        "level", *RULE_LABELS, "bucket_start", ratio(F.col("__inc"), F.lit(seconds)).alias("rate")
    )


def _grown(samples: DataFrame, series: list[str], extra: list[str], seconds: int) -> DataFrame:
    """Growth of counters per (namespace, job, route, extra) and interval, restarts included."""
    grown = counter_increase(samples, [*series, *extra], bucket_seconds=seconds, tiebreak=["tie"])
    return grown.groupBy(*RULE_LABELS, *extra, "bucket_start").agg(F.sum("increase").alias("__inc"))


def bucket_rates(samples: DataFrame, series: list[str], seconds: int = 60) -> DataFrame:
    """Summed rates of cumulative bucket counters (label ``le``) on the three label levels."""
    levels = rolled_up(_grown(samples, series, ["le"], seconds), {"__inc": F.sum("__inc")}, ["le", "bucket_start"])
    return levels.select(
        "level", *RULE_LABELS, "le", "bucket_start", ratio(F.col("__inc"), F.lit(seconds)).alias("rate")
    )


def quantiles_from_rates(samples: DataFrame, series: list[str], quantiles: dict[str, float], seconds: int = 60) -> DataFrame:
    """Quantiles per interval from the rates of bucket counters, on the three label levels."""
    rates = bucket_rates(samples, series, seconds)
    return histogram_quantiles(
        rates, ["level", *RULE_LABELS, "bucket_start"], quantiles, count="rate", monotone=True
    )


def mean_from_rates(samples: DataFrame, series: list[str], seconds: int = 60) -> DataFrame:
    """Rates of a sum and a count counter and their ratio per interval, on the three label levels.

    ``samples`` has one row per series, time and ``part`` ("sum" or "count"), so
    both counters go through one pass.
    """
    grown = _grown(samples, series, ["part"], seconds)
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("__inc")))
    base = grown.groupBy(*RULE_LABELS, "bucket_start").agg(of("sum").alias("__sum"), of("count").alias("__count"))
    levels = rolled_up(base, {"__sum": F.sum("__sum"), "__count": F.sum("__count")}, ["bucket_start"])
    rate = {name: ratio(F.col(f"__{name}"), F.lit(seconds)) for name in ("sum", "count")}
    return levels.select(
        "level",
        *RULE_LABELS,
        "bucket_start",
        rate["sum"].alias("sum_rate"),
        rate["count"].alias("count_rate"),
        ratio(rate["sum"], rate["count"]).alias("mean_seconds"),
    )


def canary_latency_alert(
    samples: DataFrame, series: list[str], seconds: int = 300, threshold: float = CANARY_SECONDS, for_seconds: int = CANARY_FOR
) -> DataFrame:
    """Jobs whose 99th percentile, from the rates of bucket counters, stayed above the threshold long enough."""
    labels = list(CANARY_LABELS)
    rates = _grown(samples, series, ["le"], seconds).groupBy(*labels, "le", "bucket_start").agg(F.sum("__inc").alias("count"))
    return true_runs(
        histogram_quantiles(rates, [*labels, "bucket_start"], {"quantile": 0.99}, monotone=True),
        labels,
        time="bucket_start",
        condition=F.col("quantile") > threshold,
        step_seconds=seconds,
        for_seconds=for_seconds,
    )


def mean_latency(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Seconds per request on the three label levels: ratio of two sums of one aggregate."""
    base = requests.groupBy(*RULE_LABELS, bucket_start(F.col("ts"), seconds).alias("bucket_start")).agg(
        F.sum("duration").alias("__sum"), F.count(F.lit(1)).alias("__n")
    )
    levels = rolled_up(base, {"__sum": F.sum("__sum"), "__n": F.sum("__n")}, ["bucket_start"])
    return levels.select("level", *RULE_LABELS, "bucket_start", ratio(F.col("__sum"), F.col("__n")).alias("mean_seconds"))


def latency_quantile(buckets: DataFrame, q: float, extra: list[str]) -> DataFrame:
    """Latency quantile on the three label levels from (labels, le, count)."""
    levels = rolled_up(buckets, {"count": F.sum("count")}, ["le", *extra])
    return histogram_quantile(levels, ["level", *RULE_LABELS, *extra], q)


def status_class(status_code: Column) -> Column:
    """``200`` to ``2xx``; a status in words stays as it is."""
    by_class = label_replace(F.lit(None).cast("string"), STATUS_CLASS[0], status_code, STATUS_CLASS[1])
    return label_replace(by_class, STATUS_WORD[0], status_code, STATUS_WORD[1])


def status_class_rate(requests: DataFrame, seconds: int = 60) -> DataFrame:
    per_class = requests.groupBy(
        bucket_start(F.col("ts"), seconds).alias("bucket_start"), status_class(F.col("status_code")).alias("status")
    ).agg(F.count(F.lit(1)).alias("__n"))
    return per_class.select("bucket_start", "status", ratio(F.col("__n"), F.lit(seconds)).alias("rate"))


def error_percent(requests: DataFrame, seconds: int = ERROR_LOOKBACK) -> DataFrame:
    """Share of server errors in percent per label set and interval."""
    labels = list(RULE_LABELS)
    shares = requests.groupBy(*labels, bucket_start(F.col("ts"), seconds).alias("bucket_start")).agg(
        F.count_if(F.col("status_code").rlike(rf"^(?s:{SERVER_ERROR})\z")).alias("__bad"),
        F.count(F.lit(1)).alias("__all"),
    )
    percent = ratio(F.lit(100.0) * F.col("__bad").cast("double"), F.col("__all"))
    return shares.select(*labels, "bucket_start", percent.alias("error_percent"))


def error_percent_alert(
    requests: DataFrame, seconds: int = ERROR_LOOKBACK, threshold: float = ERROR_PERCENT, for_seconds: int = ERROR_FOR
) -> DataFrame:
    """Label sets whose error share stayed above the threshold long enough."""
    return true_runs(
        error_percent(requests, seconds),
        list(RULE_LABELS),
        time="bucket_start",
        condition=F.col("error_percent") > threshold,
        step_seconds=seconds,
        for_seconds=for_seconds,
    )


def latency_alert(
    quantiles: DataFrame,
    labels: list[str],
    step_seconds: int,
    threshold: float = LATENCY_SECONDS,
    for_seconds: int = LATENCY_FOR,
    excluded_routes: str = LATENCY_ROUTE_EXCLUDED,
) -> DataFrame:
    """Routes whose latency quantile stayed above the threshold long enough."""
    return true_runs(
        quantiles.where(label_not_matches(F.col("route"), excluded_routes)),
        labels,
        time="bucket_start",
        condition=F.col("quantile") > threshold,
        step_seconds=step_seconds,
        for_seconds=for_seconds,
    )


def increase_alert(samples: DataFrame, series: list[str], by: list[str], seconds: int = PANIC_LOOKBACK, threshold: float = 0.0) -> DataFrame:
    """Intervals in which a counter, summed by labels, grew by more than the threshold."""
    grown = counter_increase(samples, series, bucket_seconds=seconds, tiebreak=["tie"])
    return (
        grown.groupBy(*by, "bucket_start").agg(F.sum("increase").alias("increase")).where(F.col("increase") > threshold)
    )


def more_than_one(gauge: DataFrame, by: list[str], limit: float = 1.0) -> DataFrame:
    """Label sets in which the sum of a 0/1 gauge exceeds one."""
    return gauge.groupBy(*by).agg(F.sum("value").alias("running")).where(F.col("running") > limit)


def more_than_one_for(
    samples: DataFrame,
    by: list[str],
    instance: str,
    *,
    time: str,
    step_seconds: int = 60,
    for_seconds: int = SINGLETON_FOR,
    limit: float = SINGLETON_LIMIT,
) -> DataFrame:
    """Label sets in which more than one instance ran at every evaluation for long enough; on batches and on streams.

    An instance counts in an evaluation when it reported 1 in its interval.  A
    stream needs a watermark on ``time``; its three aggregates hand it on.
    """
    window = F.window(time, f"{step_seconds} seconds").alias("w")
    reported = samples.groupBy(window, *by, instance).agg(F.max("value").alias("value"))
    running = reported.groupBy("w", *by).agg(F.sum("value").alias("running"))
    return held_sessions(
        running, by, window="w", condition=F.col("running") > limit, step_seconds=step_seconds, for_seconds=for_seconds
    )


def none_ready(gauge: DataFrame, by: list[str]) -> DataFrame:
    """Label sets in which the sum of a 0/1 gauge is zero."""
    return gauge.groupBy(*by).agg(F.sum("value").alias("ready")).where(F.col("ready") == 0)


def gauge_range(gauge: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Least and greatest value of a gauge (or of a ratio of gauges) by labels."""
    return gauge.groupBy(*by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def milliseconds(seconds: Column) -> Column:
    return seconds * F.lit(1e3)


def saturation(used: DataFrame, capacity: DataFrame, labels: list[str], by: list[str], present: DataFrame) -> DataFrame:
    """Greatest used/capacity ratio by volume, for volumes listed in ``present``."""
    total = capacity.select(*labels, F.col("value").alias("__capacity"))
    ratios = used.join(total, labels).select(*by, ratio(F.col("value"), F.col("__capacity")).alias("__r"))
    return keep_if_present(ratios.groupBy(*by).agg(F.max("__r").alias("saturation")), present, by)


def rate_by_pod(node_rates: DataFrame, containers: DataFrame, excluded_devices: str = ".*sda.*") -> DataFrame:
    """Device rates of a node on every pod that uses the device.

    ``node_rates``: instance, device, value; ``containers``: instance, pod,
    device as a path.  The pod label is ignored in matching and kept.
    """
    device = label_replace(F.col("device"), "$1", F.col("device"), "/dev/(.*)")
    pods = (
        containers.where(label_not_matches(F.col("device"), excluded_devices))
        .select("instance", "pod", device.alias("device"))
        .distinct()
    )
    return many_to_one(pods, node_rates, ["instance", "device"], F.col("__one"), out="rate")


def high_water_lag(highest: DataFrame, sent: DataFrame, by: list[str]) -> DataFrame:
    """Distance of two high-water marks; nothing sent yet counts as 0."""
    return difference_or_default(highest, sent, by, value="value", out="lag_seconds")


def oldest_age(pending: DataFrame, time: str, now: Column) -> DataFrame:
    """Age in seconds of the oldest pending row."""
    return pending.agg(
        ((F.unix_micros(now) - F.unix_micros(F.min(time))) / F.lit(1e6)).alias("oldest_age_seconds")
    )
