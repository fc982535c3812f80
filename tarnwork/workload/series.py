"""Log and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import labels
from tarnwork.functions.once import with_once
from tarnwork.operators import series as ops
from tarnwork.plans import observability as obs
from tarnwork.sources.logs import relabel
from tarnwork.workload import views as v
from tarnwork.workload.registry import VIEW_SQL, bucket_sql, query

SERIES = ["namespace", "job", "route"]
BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0]
LEVELS_SQL = "GROUPING SETS ((job{x}), (job, route{x}), (namespace, job, route{x}))"
LEVEL_NAME_SQL = """CASE WHEN grouping(route) = 1 THEN 'job' WHEN grouping(namespace) = 1 THEN 'job_route'
    ELSE 'namespace_job_route' END"""


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return relabel(v.raw_log_lines(spark, sf))


# -- logs --------------------------------------------------------------------


@query("log_contains", "SELECT * FROM v_log_lines WHERE namespace = 'ns-1' AND contains(line, 'msg=signup')")
def log_contains(spark: SparkSession, sf: str) -> DataFrame:
    return obs.lines_with(_logs(spark, sf), "msg=signup", namespace="ns-1")


@query(
    "log_count_bucket",
    f"""SELECT {bucket_sql('ts', 3600)} AS bucket_start, count(*) AS line_count
    FROM v_log_lines WHERE contains(line, 'msg=error') AND namespace = 'ns-0' GROUP BY 1""",
)
def log_count_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return obs.count_over_time(_logs(spark, sf), 3600, text="msg=error", namespace="ns-0")


@query(
    "log_credential_leak",
    f"""SELECT {bucket_sql('ts', 300)} AS bucket_start, job, pod, count(*) AS line_count FROM v_log_lines
    WHERE regexp_matches(line, 'http(s?)://(\\w+):(\\w+)@') GROUP BY ALL""",
)
def log_credential_leak(spark: SparkSession, sf: str) -> DataFrame:
    return obs.credential_leaks(_logs(spark, sf), ["job", "pod"])


@query(
    "log_fields",
    r"""SELECT ts, pod, regexp_extract(line, 'level=(\S*)', 1) AS level, regexp_extract(line, 'msg=(\S*)', 1) AS msg,
        regexp_extract(line, 'value=(\S*)', 1) AS value, nullif(regexp_extract(line, 'url=(\S*)', 1), '') AS url
    FROM v_log_lines""",
)
def log_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = with_once(_logs(spark, sf), "f", labels.logfmt_fields(F.col("line")))
    return fields.select(
        "ts", "pod", *[F.try_element_at("f", F.lit(k)).alias(k) for k in ("level", "msg", "value", "url")]
    )


@query(
    "log_rate_by_level",
    f"""SELECT {bucket_sql('ts', 300)} AS bucket_start, regexp_extract(line, 'level=(\\S*)', 1) AS level,
        CAST(count(*) AS DOUBLE) / 300 AS rate FROM v_log_lines GROUP BY 1, 2""",
)
def log_rate_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return obs.log_rate_by_level(_logs(spark, sf))


@query(
    "log_error_ratio",
    f"""SELECT * FROM (SELECT {bucket_sql('ts', 3600)} AS bucket_start, job,
        CAST(count(*) FILTER (contains(line, 'error')) AS DOUBLE) / count(*) AS error_ratio FROM v_log_lines GROUP BY 1, 2)
    WHERE error_ratio > 0.05""",
)
def log_error_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return obs.error_line_ratio(_logs(spark, sf), ["job"], seconds=3600)


@query(
    "label_match",
    """SELECT namespace, job, route, count(*) AS n FROM v_requests_series
    WHERE namespace = 'ns-1' AND regexp_full_match(job, 'svc-(0|2)') AND NOT regexp_full_match(route, '(?i).*SIGN.*')
    GROUP BY ALL""",
)
def label_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.requests_series(spark, sf)
    chosen = rows.where(
        (F.col("namespace") == "ns-1")
        & labels.label_matches(F.col("job"), "svc-(0|2)")
        & labels.label_not_matches(F.col("route"), "(?i).*SIGN.*")
    )
    return chosen.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))


# -- counters ----------------------------------------------------------------

VIEW_SQL["v_counter_steps"] = """
SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step FROM (
    SELECT *, lag(value) OVER (PARTITION BY namespace, job, route ORDER BY ts, tie) AS prev FROM v_counter)
"""


@query(
    "counter_rate",
    f"""SELECT namespace, job, route, {bucket_sql('ts', 300)} AS bucket_start, sum(step) / 300 AS rate
    FROM v_counter_steps GROUP BY ALL""",
)
def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    return ops.counter_rate(v.counter(spark, sf), SERIES, bucket_seconds=300, tiebreak=["tie"])


@query(
    "counter_increase",
    f"""SELECT namespace, job, {bucket_sql('ts', 600)} AS bucket_start, sum(step) AS increase
    FROM v_counter_steps GROUP BY ALL HAVING sum(step) > 0""",
)
def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    return obs.increase_alert(v.counter(spark, sf), SERIES, ["namespace", "job"])


@query(
    "series_changes",
    f"""SELECT namespace, job, {bucket_sql('ts', 3600)} AS bucket_start,
        count(*) FILTER (prev IS NOT NULL AND value <> prev) AS changes
    FROM (SELECT *, lag(value) OVER (PARTITION BY namespace, job ORDER BY ts, tie) AS prev
          FROM (SELECT * REPLACE (floor(value / 10) AS value) FROM v_counter)) GROUP BY ALL""",
)
def series_changes(spark: SparkSession, sf: str) -> DataFrame:
    tens = v.counter(spark, sf).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return ops.value_changes(tens, ["namespace", "job"], tiebreak=["tie"], bucket_seconds=3600)


@query(
    "rate_sum_by",
    f"""SELECT {LEVEL_NAME_SQL} AS level, namespace, job, route, bucket_start, sum(step) / 60 AS rate
    FROM (SELECT *, {bucket_sql('ts', 60)} AS bucket_start FROM v_counter_steps)
    GROUP BY {LEVELS_SQL.format(x=', bucket_start')}""",
)
def rate_sum_by(spark: SparkSession, sf: str) -> DataFrame:
    return obs.rate_sums(v.counter(spark, sf), SERIES)


# -- requests ----------------------------------------------------------------


@query(
    "latency_avg",
    f"""SELECT {LEVEL_NAME_SQL} AS level, namespace, job, route, bucket_start,
        CAST(sum(duration) AS DOUBLE) / count(*) AS mean_seconds
    FROM (SELECT *, {bucket_sql('ts', 3600)} AS bucket_start FROM v_requests_series)
    GROUP BY {LEVELS_SQL.format(x=', bucket_start')}""",
)
def latency_avg(spark: SparkSession, sf: str) -> DataFrame:
    return obs.mean_latency(v.requests_series(spark, sf), seconds=3600)


@query(
    "status_class_rate",
    f"""SELECT {bucket_sql('ts', 600)} AS bucket_start,
        CASE WHEN status_code = 'success' THEN 'success' ELSE left(status_code, 1) || 'xx' END AS status,
        CAST(count(*) AS DOUBLE) / 600 AS rate FROM v_requests_series GROUP BY 1, 2""",
)
def status_class_rate(spark: SparkSession, sf: str) -> DataFrame:
    return obs.status_class_rate(v.requests_series(spark, sf), seconds=600)


_BUCKETS_SQL = """
SELECT {labels}, le, CAST(count(*) FILTER (CAST(duration AS DOUBLE) <= le) AS DOUBLE) AS c
FROM {rows}, (SELECT unnest([0.1::DOUBLE, 0.5, 1, 2, 5, 'Infinity']) AS le) GROUP BY ALL
"""


def _quantile_sql(source: str, labels: str, q: float) -> str:
    """Independent form: the first bound that reaches the rank, found by a self-contained scan."""
    return f"""
    SELECT {labels}, CASE WHEN total = 0 THEN NULL WHEN le = 'Infinity' THEN lo
        ELSE coalesce(lo, 0) + (le - coalesce(lo, 0)) * (total * {q} - coalesce(c0, 0)) / nullif(c - coalesce(c0, 0), 0) END AS quantile
    FROM (SELECT *, max(c) OVER (PARTITION BY {labels}) AS total, lag(le) OVER w AS lo, lag(c) OVER w AS c0
          FROM ({source}) WINDOW w AS (PARTITION BY {labels} ORDER BY le))
    QUALIFY row_number() OVER (PARTITION BY {labels} ORDER BY CASE WHEN c >= total * {q} THEN le END NULLS LAST) = 1
    """


_LEVEL_BUCKETS = f"""
SELECT {LEVEL_NAME_SQL} AS level, namespace, job, route, le, sum(c) AS c
FROM ({_BUCKETS_SQL.format(labels='namespace, job, route', rows='v_requests_series')})
GROUP BY {LEVELS_SQL.format(x=', le')}
"""


def _buckets(spark: SparkSession, sf: str, extra: list[str] | None = None) -> DataFrame:
    from tarnwork.functions.times import bucket_start

    rows = v.requests_series(spark, sf)
    if extra:
        rows = rows.withColumn("bucket_start", bucket_start(F.col("ts"), 3600))
    return ops.cumulative_buckets(rows, SERIES + (extra or []), value="duration", bounds=BOUNDS)


@query("hist_buckets", _BUCKETS_SQL.format(labels="namespace, job, route", rows="v_requests_series").replace(" AS c\n", " AS count\n"))
def hist_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _buckets(spark, sf)


@query("hist_q50", _quantile_sql(_LEVEL_BUCKETS, "level, namespace, job, route", 0.5))
def hist_q50(spark: SparkSession, sf: str) -> DataFrame:
    return obs.latency_quantile(_buckets(spark, sf), 0.5, [])


@query("hist_q99", _quantile_sql(_LEVEL_BUCKETS, "level, namespace, job, route", 0.99))
def hist_q99(spark: SparkSession, sf: str) -> DataFrame:
    return obs.latency_quantile(_buckets(spark, sf), 0.99, [])


# -- rules from counters ------------------------------------------------------

VIEW_SQL["v_bucket_rates"] = f"""
SELECT {LEVEL_NAME_SQL} AS level, namespace, job, route, le, bucket_start, sum(step) / 3600 AS rate
FROM (SELECT *, {bucket_sql('ts', 3600)} AS bucket_start, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step
      FROM (SELECT *, lag(value) OVER (PARTITION BY namespace, job, route, pod, le ORDER BY ts, tie) AS prev FROM v_bucket_counters))
GROUP BY {LEVELS_SQL.format(x=', le, bucket_start')}
"""
VIEW_SQL["v_monotone_rates"] = """
SELECT * EXCLUDE (rate), max(rate) OVER (PARTITION BY level, namespace, job, route, bucket_start ORDER BY le) AS c FROM v_bucket_rates
"""
COUNTER_SERIES = [*SERIES, "pod"]
_RATE_LABELS = "level, namespace, job, route, bucket_start"


@query("bucket_rate_sum", "SELECT * FROM v_bucket_rates")
def bucket_rate_sum(spark: SparkSession, sf: str) -> DataFrame:
    return obs.bucket_rates(v.bucket_counters(spark, sf), COUNTER_SERIES, seconds=3600)


@query(
    "quantile_from_rates",
    f"""SELECT a.*, b.quantile AS p99 FROM
        (SELECT * EXCLUDE (quantile), quantile AS p50 FROM ({_quantile_sql("SELECT * FROM v_monotone_rates", _RATE_LABELS, 0.5)})) a
        JOIN ({_quantile_sql("SELECT * FROM v_monotone_rates", _RATE_LABELS, 0.99)}) b
        ON (a.level, a.bucket_start) = (b.level, b.bucket_start) AND a.job = b.job
        AND a.namespace IS NOT DISTINCT FROM b.namespace AND a.route IS NOT DISTINCT FROM b.route""",
)
def quantile_from_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly median and 99th percentile from the bucket counters of all pods."""
    return obs.quantiles_from_rates(v.bucket_counters(spark, sf), COUNTER_SERIES, {"p50": 0.5, "p99": 0.99}, seconds=3600)


@query(
    "mean_from_rates",
    f"""SELECT *, sum_rate / nullif(count_rate, 0) AS mean_seconds FROM (
        SELECT {LEVEL_NAME_SQL} AS level, namespace, job, route, bucket_start,
            sum(step) FILTER (part = 'sum') / 3600 AS sum_rate, sum(step) FILTER (part = 'count') / 3600 AS count_rate
        FROM (SELECT *, {bucket_sql('ts', 3600)} AS bucket_start, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step
              FROM (SELECT *, lag(value) OVER (PARTITION BY namespace, job, route, pod, part ORDER BY ts, tie) AS prev FROM v_latency_counters))
        GROUP BY {LEVELS_SQL.format(x=', bucket_start')})""",
)
def mean_from_rates(spark: SparkSession, sf: str) -> DataFrame:
    return obs.mean_from_rates(v.latency_counters(spark, sf), COUNTER_SERIES, seconds=3600)


# -- alerts ------------------------------------------------------------------


def _runs_sql(source: str, labels: str, condition: str, step: int, hold: int) -> str:
    return f"""
    SELECT {labels}, min(bucket_start) AS active_since, min(bucket_start) + INTERVAL {hold} SECOND AS firing_since,
        max(bucket_start) AS last_true
    FROM (SELECT *, sum(start) OVER (PARTITION BY {labels} ORDER BY bucket_start) AS run FROM (
        SELECT *, CASE WHEN lag(bucket_start) OVER (PARTITION BY {labels} ORDER BY bucket_start)
            = bucket_start - INTERVAL {step} SECOND THEN 0 ELSE 1 END AS start
        FROM ({source}) WHERE {condition}))
    GROUP BY {labels}, run HAVING max(bucket_start) - min(bucket_start) >= INTERVAL {hold} SECOND
    """


@query(
    "alert_error_pct",
    _runs_sql(
        f"""SELECT namespace, job, route, {bucket_sql('ts', 3600)} AS bucket_start,
            100 * CAST(count(*) FILTER (status_code LIKE '5__') AS DOUBLE) / count(*) AS pct
        FROM v_requests_series GROUP BY ALL""",
        "namespace, job, route",
        "pct > 10",
        3600,
        7200,
    ),
)
def alert_error_pct(spark: SparkSession, sf: str) -> DataFrame:
    return obs.error_percent_alert(v.requests_series(spark, sf), seconds=3600, for_seconds=7200)


_HOURLY_BUCKETS = _BUCKETS_SQL.format(
    labels="namespace, job, route, bucket_start",
    rows=f"(SELECT *, {bucket_sql('ts', 3600)} AS bucket_start FROM v_requests_series)",
)


@query(
    "alert_for",
    _runs_sql(
        _quantile_sql(_HOURLY_BUCKETS, "namespace, job, route, bucket_start", 0.99),
        "namespace, job, route",
        "quantile > 0.3 AND NOT regexp_full_match(route, '(?i).*VIEW.*')",
        3600,
        7200,
    ),
)
def alert_for(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly p99 above a bound for two hours, without one route."""
    quantiles = ops.histogram_quantile(_buckets(spark, sf, ["bucket_start"]), SERIES + ["bucket_start"], 0.99)
    return obs.latency_alert(
        quantiles, SERIES, 3600, threshold=0.3, for_seconds=7200, excluded_routes="(?i).*VIEW.*"
    )


@query(
    "alert_singleton",
    "SELECT cluster, namespace, sum(value) AS running FROM v_gauge GROUP BY ALL HAVING sum(value) > 1",
)
def alert_singleton(spark: SparkSession, sf: str) -> DataFrame:
    return obs.more_than_one(v.gauge(spark, sf), ["cluster", "namespace"])


VIEW_SQL["v_running_at"] = f"""
SELECT cluster, namespace, bucket_start, sum(value) AS running FROM (
    SELECT cluster, namespace, instance, {bucket_sql('ts', 3600)} AS bucket_start, max(value) AS value FROM v_running GROUP BY ALL)
GROUP BY ALL
"""


def singleton_sql(source: str) -> str:
    runs = _runs_sql(source, "cluster, namespace", "running > 1", 3600, 3600)
    return f"SELECT *, (epoch_us(last_true) - epoch_us(active_since)) // 3600000000 + 1 AS evaluations FROM ({runs})"


@query("alert_singleton_for", singleton_sql("SELECT * FROM v_running_at"))
def alert_singleton_for(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters in which more than one instance ran at two or more hourly evaluations in a row."""
    return obs.more_than_one_for(
        v.running(spark, sf), ["cluster", "namespace"], "instance", time="ts", step_seconds=3600, for_seconds=3600
    )


@query(
    "alert_canary_latency",
    _runs_sql(
        _quantile_sql(
            f"""SELECT * EXCLUDE (n), max(n) OVER (PARTITION BY namespace, job, bucket_start ORDER BY le) AS c FROM (
                SELECT namespace, job, le, bucket_start, sum(step) AS n
                FROM (SELECT *, {bucket_sql('ts', 3600)} AS bucket_start,
                        CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step
                      FROM (SELECT *, lag(value) OVER (PARTITION BY namespace, job, route, pod, le ORDER BY ts, tie) AS prev FROM v_bucket_counters))
                GROUP BY ALL)""",
            "namespace, job, bucket_start",
            0.99,
        ),
        "namespace, job",
        "quantile > 3",
        3600,
        7200,
    ),
)
def alert_canary_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly p99 from counters above three seconds for two hours."""
    return obs.canary_latency_alert(
        v.bucket_counters(spark, sf), COUNTER_SERIES, seconds=3600, threshold=3.0, for_seconds=7200
    )


@query(
    "alert_none_ready",
    "SELECT cluster, instance, sum(value) AS ready FROM v_gauge GROUP BY ALL HAVING sum(value) = 0",
)
def alert_none_ready(spark: SparkSession, sf: str) -> DataFrame:
    return obs.none_ready(v.gauge(spark, sf), ["cluster", "instance"])


# -- series joins ------------------------------------------------------------

VIEW_SQL["v_node_rates"] = """
SELECT 'node-' || (user_id % 3) AS instance, event_type AS device, CAST(count(*) AS DOUBLE) / 3600 AS value FROM events GROUP BY ALL
"""


@query(
    "series_group_right",
    """SELECT instance, pod, device, value AS rate FROM v_node_rates JOIN (
        SELECT DISTINCT 'node-' || (user_id % 3) AS instance, 'pod-' || (user_id % 10) AS pod, event_type AS device FROM events
        WHERE event_type <> 'signup') USING (instance, device)""",
)
def series_group_right(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events")
    instance = F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("instance")
    rates = rows.groupBy(instance, F.col("event_type").alias("device")).agg(
        (F.count(F.lit(1)).cast("double") / 3600).alias("value")
    )
    pods = rows.select(
        instance,
        F.concat(F.lit("pod-"), (F.col("user_id") % 10).cast("string")).alias("pod"),
        F.concat(F.lit("/dev/"), "event_type").alias("device"),
    )
    return obs.rate_by_pod(rates, pods, excluded_devices=".*sign.*")


@query(
    "gauge_min_max",
    """SELECT 'pod-' || (user_id % 10) AS pod, min(value) AS min_value, max(value) AS max_value,
        max(value) * CAST(1000 AS DOUBLE) AS max_millis FROM events GROUP BY 1""",
)
def gauge_min_max(spark: SparkSession, sf: str) -> DataFrame:
    pod = F.concat(F.lit("pod-"), (F.col("user_id") % 10).cast("string")).alias("pod")
    ranges = obs.gauge_range(v.table(spark, sf, "events").select(pod, "value"), ["pod"])
    return ranges.withColumn("max_millis", obs.milliseconds(F.col("max_value")))


@query(
    "series_and",
    """SELECT namespace, job, route, count(*) AS n FROM v_requests_series
    WHERE (namespace, job) IN (SELECT (namespace, job) FROM v_counter WHERE value = 499) GROUP BY ALL""",
)
def series_and(spark: SparkSession, sf: str) -> DataFrame:
    """Request counts of the label sets whose counter has been full."""
    counted = v.requests_series(spark, sf).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    full = v.counter(spark, sf).where(F.col("value") == 499)
    return ops.keep_if_present(counted, full, ["namespace", "job"])


VIEW_SQL["v_volumes"] = """
SELECT event_type AS node, 'vol-' || (user_id % 20) AS volume, max(value) AS used, max(value) + count(*) AS capacity
FROM events GROUP BY ALL
"""


@query(
    "saturation",
    """SELECT volume, max(used / capacity) AS saturation FROM v_volumes
    WHERE volume IN (SELECT 'vol-' || (user_id % 20) FROM events WHERE value > 250) GROUP BY volume""",
)
def saturation(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events").select(
        F.col("event_type").alias("node"),
        F.concat(F.lit("vol-"), (F.col("user_id") % 20).cast("string")).alias("volume"),
        "value",
    )
    by_volume = rows.groupBy("node", "volume")
    used = by_volume.agg(F.max("value").alias("value"))
    capacity = by_volume.agg((F.max("value") + F.count(F.lit(1))).alias("value"))
    listed = rows.where(F.col("value") > 250)
    return obs.saturation(used, capacity, ["node", "volume"], ["volume"], listed)


@query(
    "replication_lag",
    """SELECT tenant, h - coalesce(s, 0) AS lag_seconds FROM (
        SELECT 'tenant-' || (user_id % 10) AS tenant, CAST(max(event_id) AS DOUBLE) AS h,
            CAST(max(event_id) FILTER (event_type = 'view' AND value > 250) AS DOUBLE) AS s
        FROM events GROUP BY 1)""",
)
def replication_lag(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events")
    tenant = F.concat(F.lit("tenant-"), (F.col("user_id") % 10).cast("string")).alias("tenant")
    mark = F.max("event_id").cast("double").alias("value")
    highest = rows.groupBy(tenant).agg(mark)
    sent = rows.where((F.col("event_type") == "view") & (F.col("value") > 250)).groupBy(tenant).agg(mark)
    return obs.high_water_lag(highest, sent, ["tenant"])


@query(
    "oldest_pending",
    """SELECT CAST(epoch_us(TIMESTAMP '2010-01-01') - epoch_us(min(activated_at)) AS DOUBLE) / 1000000 AS oldest_age_seconds
    FROM v_approval_steps WHERE status = 'pending'""",
)
def oldest_pending(spark: SparkSession, sf: str) -> DataFrame:
    pending = v.approval_steps(spark, sf).where(F.col("status") == "pending")
    return obs.oldest_age(pending, "activated_at", F.lit("2010-01-01").cast("timestamp"))
