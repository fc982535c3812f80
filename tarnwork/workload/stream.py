"""Streaming queries: run over the whole log until it is used up, then read the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.plans import features, quality
from tarnwork.plans.observability import more_than_one_for
from tarnwork.schemas import DEVICE_EVENT
from tarnwork.session import large_state, scratch_path
from tarnwork.sinks.tables import write_messages, write_messages_in_order
from tarnwork.sources import events as event_source
from tarnwork.streaming import events as streams
from tarnwork.streaming.fanout import progress_counts
from tarnwork.workload import views as v
from tarnwork.workload.registry import VIEW_SQL, bucket_sql, query, stored_input
from tarnwork.workload.series import singleton_sql


def _log(spark: SparkSession, sf: str) -> str:
    """The events as a folder of JSON lines in the order of time, one file for five days."""

    def write(path: str) -> None:
        write_messages_in_order(v.device_json(spark, sf), "part", path, scratch_path(spark, "slices"))

    return stored_input(spark, "log", [f"{sf}/events.parquet"], write)


def _messages(spark: SparkSession, sf: str, **options) -> DataFrame:
    return event_source.read_messages(spark, path=_log(spark, sf), **options)


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream until its input is used up and read what it wrote."""
    path = scratch_path(spark, name)
    streams.finish(streams.start_append(stream, path, scratch_path(spark, "ckpt"), available_now=True))
    return spark.read.schema(stream.schema).parquet(path)


VIEW_SQL["v_closed"] = f"""
SELECT * FROM (
    SELECT {bucket_sql('event_time', 60)} AS window_start, {bucket_sql('event_time', 60)} + INTERVAL 1 MINUTE AS window_end,
        device_id, count(*) AS event_count
    FROM v_decoded GROUP BY ALL)
WHERE window_end <= (SELECT max(event_time) - INTERVAL 10 SECOND FROM v_decoded)
"""


@query(
    "stream_source",
    """SELECT event_id, device_id, readable FROM (
        SELECT CASE WHEN event_id % 97 <> 0 THEN event_id END AS event_id,
            CASE WHEN event_id % 97 <> 0 THEN device_id END AS device_id, event_id % 97 <> 0 AS readable FROM v_device_events)""",
)
def stream_source(spark: SparkSession, sf: str) -> DataFrame:
    decoded = event_source.decode_messages(_messages(spark, sf))
    return _run(spark, decoded.select("event_id", "device_id", "readable"), "source")


@query("stream_detail", "SELECT * FROM v_decoded")
def stream_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, streams.detail(_messages(spark, sf)), "detail")


@query("stream_tumble_1m", "SELECT * FROM v_closed")
def stream_tumble_1m(spark: SparkSession, sf: str) -> DataFrame:
    """One file of the log per trigger; windows that the watermark has passed leave the state, which is in RocksDB."""
    one_by_one = _messages(spark, sf, **event_source.admission(files=1))
    with large_state(spark):
        return _run(spark, streams.tumbling_counts(streams.detail(one_by_one)), "windows")


VIEW_SQL["v_stream_running"] = f"""
SELECT cluster, namespace, bucket_start, sum(value) AS running FROM (
    SELECT event_type AS cluster, 'ns-' || (device % 3) AS namespace, device, {bucket_sql('event_time', 3600)} AS bucket_start,
        CAST(CASE WHEN device % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value
    FROM (SELECT *, CAST(substr(device_id, 8) AS BIGINT) AS device FROM v_decoded) GROUP BY ALL)
GROUP BY ALL
"""


@query(
    "stream_alert_singleton",
    f"""SELECT * FROM ({singleton_sql('SELECT * FROM v_stream_running')})
    WHERE last_true + INTERVAL 9000 SECOND <= (SELECT max(event_time) - INTERVAL 10 SECOND FROM v_decoded)""",
)
def stream_alert_singleton(spark: SparkSession, sf: str) -> DataFrame:
    """``alert_singleton_for`` on the stream, over the log one file per trigger; a run is written when it has ended."""
    events = streams.detail(_messages(spark, sf, **event_source.admission(files=1)))
    device = F.substring_index("device_id", "-", -1).cast("long")
    reports = events.select(
        F.col("event_type").alias("cluster"),
        F.concat(F.lit("ns-"), (device % 3).cast("string")).alias("namespace"),
        device.alias("instance"),
        "event_time",
        F.when(device % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
    ).withWatermark("event_time", streams.WATERMARK)
    runs = more_than_one_for(
        reports, ["cluster", "namespace"], "instance", time="event_time", step_seconds=3600, for_seconds=3600
    )
    return _run(spark, runs, "singleton")


@query(
    "tumble_1m",
    f"""SELECT {bucket_sql('event_time', 60)} AS window_start, {bucket_sql('event_time', 60)} + INTERVAL 1 MINUTE AS window_end,
        device_id, count(*) AS event_count FROM v_device_events GROUP BY ALL""",
)
def tumble_1m(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling_counts(v.device_events(spark, sf))


@query("stream_dedup", "SELECT * FROM v_decoded")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The log delivered twice at the same time: every event once."""
    messages = _messages(spark, sf)
    twice = messages.select(F.explode(F.array_repeat("value", 2)).alias("value"))
    path = scratch_path(spark, "distinct")
    streams.finish(streams.start_distinct(streams.detail(twice), path, scratch_path(spark, "ckpt"), available_now=True))
    return spark.read.schema(DEVICE_EVENT).parquet(path).select(*DEVICE_EVENT.fieldNames())


@query(
    "stream_two_sinks",
    """SELECT 'detail' AS sink, count(*) AS row_count, count(*) AS event_count FROM v_decoded
    UNION ALL SELECT 'windows', count(*), CAST(sum(event_count) AS BIGINT) FROM v_closed""",
)
def stream_two_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables from one read of the log, in several batches."""
    detail_path, window_path, marks = (scratch_path(spark, n) for n in ("detail", "windows", "marks"))
    messages = _messages(spark, sf, **event_source.admission(files=2))
    streams.finish(
        streams.start_two_sinks(messages, detail_path, window_path, marks, scratch_path(spark, "ckpt"), available_now=True)
    )
    detail, windows = streams.read_detail(spark, detail_path, marks), streams.read_windows(spark, window_path, marks)
    one = F.count(F.lit(1))
    return detail.agg(F.lit("detail").alias("sink"), one.alias("row_count"), one.alias("event_count")).unionByName(
        windows.agg(F.lit("windows").alias("sink"), one.alias("row_count"), F.sum("event_count").alias("event_count"))
    )


# Errors arrive in a second delivery, after the first has moved the watermark.
VIEW_SQL["v_late"] = "SELECT *, event_type = 'error' AS late FROM v_decoded"
VIEW_SQL["v_late_windows"] = f"""
SELECT window_start, window_end, device_id, count(*) AS detail_count,
    count(*) FILTER (NOT late OR window_end > (SELECT max(event_time) - INTERVAL 10 SECOND FROM v_late WHERE NOT late)) AS window_count
FROM (SELECT *, {bucket_sql('event_time', 60)} AS window_start,
        {bucket_sql('event_time', 60)} + INTERVAL 1 MINUTE AS window_end FROM v_late)
WHERE window_end <= (SELECT max(event_time) - INTERVAL 10 SECOND FROM v_late)
GROUP BY window_start, window_end, device_id
"""


@query("stream_late_split", "SELECT *, detail_count - window_count AS late_count FROM v_late_windows")
def stream_late_split(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries with a restart between them; what came too late is in the detail table only."""
    log, checkpoint, marks = (scratch_path(spark, n) for n in ("log", "ckpt", "marks"))
    detail_path, window_path = scratch_path(spark, "detail"), scratch_path(spark, "windows")
    messages = v.device_json(spark, sf)
    late = F.col("event_type") == "error"
    for delivery in (messages.where(~late), messages.where(late)):
        write_messages(delivery, path=log)
        read = event_source.read_messages(spark, path=log)
        streams.finish(streams.start_two_sinks(read, detail_path, window_path, marks, checkpoint, available_now=True))
    return streams.window_report(spark, window_path, marks)


@query(
    "stream_dedup_window",
    """SELECT event_id, device_id, event_type, value, event_time,
        event_type = 'signup' AND dayofmonth(event_time) <= 25 AS late FROM v_decoded""",
)
def stream_dedup_window(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats within the watermark delay are dropped; events behind the watermark are in a sink of their own.

    The log comes in seven batches: six in the order of time, in which errors
    are sent twice, then the signups of the first five with errors once more.
    """
    log, staging, checkpoint, marks = (scratch_path(spark, n) for n in ("log", "slices", "ckpt", "marks"))
    on_time, late, once = (scratch_path(spark, n) for n in ("on_time", "late", "distinct"))
    messages = v.device_json(spark, sf)
    signup, error, first = F.col("event_type") == "signup", F.col("event_type") == "error", F.col("part") < 5
    parts = messages.where(~(signup & first)).unionByName(messages.where(error)).withColumn("turn", F.col("part"))
    behind = messages.where((signup & first) | (error & (F.col("part") == 0))).withColumn("turn", F.lit(100))
    write_messages_in_order(parts.unionByName(behind), "turn", log, staging)
    events = streams.detail(event_source.read_messages(spark, path=log, **event_source.admission(files=1)))
    kind = {"available_now": True, "one_file": True}
    streams.finish(streams.start_split(events, on_time, late, marks, f"{checkpoint}/split", **kind))
    streams.finish(streams.start_deduplicated(spark, on_time, once, f"{checkpoint}/once", **kind))
    distinct = spark.read.schema(DEVICE_EVENT).parquet(once)
    behind = streams.late_events(spark, late, marks, distinct)
    return distinct.withColumn("late", F.lit(False)).unionByName(behind.withColumn("late", F.lit(True)))


@query(
    "stream_static_enrich",
    """SELECT event_id, device_id, value, event_time, latest_type FROM v_decoded LEFT JOIN (
        SELECT device_id, event_type AS latest_type FROM v_device_events WHERE event_time < TIMESTAMP '2024-01-10'
        QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time DESC, event_id DESC) = 1) USING (device_id)""",
)
def stream_static_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Live events with the type each device reported last before a day."""
    view = features.FeatureView(
        "device_last", ("device_id",), ("event_type",), time="event_time", tiebreak=("event_id",)
    )
    snapshot = features.materialize(v.device_events(spark, sf), view, "2000-01-01", "2024-01-09 23:59:59.999999")
    live = streams.detail(_messages(spark, sf)).drop("event_type")
    static = snapshot.select("device_id", F.col("event_type").alias("latest_type"))
    return _run(spark, streams.enriched(live, static), "enriched")


@query(
    "stream_audit",
    """SELECT before_count, after_count, input_rows, input_rows - after_count AS unreadable_rows, after_count > before_count AS passed
    FROM (SELECT (SELECT count(*) FROM v_decoded WHERE event_type <> 'error') AS before_count,
        (SELECT count(*) FROM v_decoded) AS after_count, (SELECT count(*) FROM v_device_events) AS input_rows)""",
)
def stream_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that two runs of the detail stream took and wrote, as the runs themselves report them: no table is read."""
    log, checkpoint, path = scratch_path(spark, "log"), scratch_path(spark, "ckpt"), scratch_path(spark, "detail")
    messages = v.device_json(spark, sf)
    late = F.col("event_type") == "error"
    reports = []
    for delivery in (messages.where(~late), messages.where(late)):
        write_messages(delivery, path=log)
        stream = streams.audited(event_source.read_messages(spark, path=log))
        run = streams.finish(streams.start_append(stream, path, checkpoint, available_now=True))
        reports.append(progress_counts(run, streams.AUDIT))
    return quality.growth(spark, reports)
