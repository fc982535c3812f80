"""Streaming jobs on device events: detail copy, tumbling counts, dedup, enrichment.

Event time must be TIMESTAMP: watermarks do not accept times without a zone.
Every sink takes a checkpoint folder; with the file sink and its commit log a
restarted query neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnwork.operators.keyed import rows_not_in, salted_lookup
from tarnwork.schemas import DEVICE_EVENT, WINDOW_COUNT
from tarnwork.sources.events import admission, decode_messages, valid_events
from tarnwork.streaming.fanout import BATCH, Sink, read_marks, read_sink, start_fan_out

# ---- fixed values: times of the stream job ---------------------------------
WATERMARK_SECONDS = 10
WATERMARK = f"{WATERMARK_SECONDS} seconds"
WINDOW = "1 minute"
COMMIT_INTERVAL = "30 seconds"
# ---------------------------------------------------------------------------

#: Name of the counts that the runs of ``audited`` report.
AUDIT = "audit"


def detail(messages: DataFrame) -> DataFrame:
    """Every valid message as an event row; stateless, late rows included."""
    return valid_events(decode_messages(messages)).select(*DEVICE_EVENT.fieldNames())


def audited(messages: DataFrame) -> DataFrame:
    """``detail`` whose runs report, under ``AUDIT``, how many messages they saw and how many of them became events."""
    decoded = decode_messages(messages)
    valid = F.col("event_time").isNotNull()
    seen = decoded.observe(AUDIT, F.count(F.lit(1)).alias("messages"), F.count_if(valid).alias("events"))
    return valid_events(seen).select(*DEVICE_EVENT.fieldNames())


def tumbling_counts(events: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """Events per device and window [start, end); works on streams and on batches.

    On a stream a window is emitted once, when the watermark passes its end.
    """
    return (
        events.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window).alias("w"), "device_id")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "device_id", "event_count"
        )
    )


def deduplicated(events: DataFrame, key: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """Drops repeats of a key that arrive within the watermark delay."""
    return events.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])


def start_distinct(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    key: str = "event_id",
    time: str = "event_time",
    available_now: bool = False,
    interval: str = COMMIT_INTERVAL,
) -> StreamingQuery:
    """Append every (key, day) once to a folder partitioned by day, however the log is cut into batches.

    ``deduplicated`` forgets keys and drops first arrivals behind its watermark,
    which suits a window after it but not a detail table.  Here a batch is
    reduced to one row per key and compared with the table's rows of the same
    days, so late rows are kept and a repeat is found whenever it comes.  A batch
    that runs again after a failure finds its own rows and adds nothing.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("event_date", T.DateType())])
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("append").partitionBy("event_date").parquet(path)

    def add_new(batch: DataFrame, number: int) -> None:
        rest = [time, *(c for c in batch.columns if c not in (key, time))]
        once = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")
        once = once.withColumn("event_date", F.to_date(time)).persist()
        try:
            days = once.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last")).first()
            if days.first is None:
                return
            table = batch.sparkSession.read.schema(schema).parquet(path)
            known = table.where(F.col("event_date").between(days.first, days.last)).select(
                F.col(key).alias("__key"), F.col("event_date").alias("__date")
            )
            same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("event_date") == F.col("__date"))
            fresh = once.join(known, same, "left_anti").select(*schema.fieldNames()).hint("rebalance", "event_date")
            fresh.write.mode("append").partitionBy("event_date").parquet(path)
        finally:
            once.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return stream.writeStream.foreachBatch(add_new).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def enriched(events: DataFrame, snapshot: DataFrame, key: str = "device_id", salts: int = 8) -> DataFrame:
    """Live events with the snapshot values of their key; unknown keys give nulls.

    A small snapshot is broadcast by its size; a larger one is joined by
    (key, salt), so a device with most of the events does not hold up a batch.
    """
    return salted_lookup(events, snapshot, key, spread_by="event_id", salts=salts)


def start_append(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    available_now: bool = False,
    interval: str = COMMIT_INTERVAL,
    by_date_of: str | None = None,
) -> StreamingQuery:
    """Append a stream to a Parquet folder, committing every interval.

    ``by_date_of`` names a time column: the folder is then partitioned by its date.
    """
    if by_date_of:
        stream = stream.withColumn("event_date", F.to_date(by_date_of))
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if by_date_of:
        writer = writer.partitionBy("event_date")
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def start_windows(
    spark, detail_path: str, path: str, checkpoint: str, *, available_now: bool = False, interval: str = COMMIT_INTERVAL
) -> StreamingQuery:
    """Tumbling counts as a stream over the detail table."""
    events = spark.readStream.schema(DEVICE_EVENT).parquet(detail_path)
    return start_append(tumbling_counts(events), path, checkpoint, available_now=available_now, interval=interval)


def start_two_sinks(
    messages: DataFrame,
    detail_path: str,
    window_path: str,
    marks: str,
    checkpoint: str,
    *,
    available_now: bool = False,
    interval: str = COMMIT_INTERVAL,
) -> StreamingQuery:
    """Detail table and window counts from one read of the log.

    A micro-batch goes to both sinks; the second one gets its counts per window
    and device, with those of windows that had closed before as ``late``.  A
    batch that runs again replaces its rows in both, see ``fanout``.
    """
    sinks = [
        Sink(detail_path, lambda rows, _: rows.select(*DEVICE_EVENT.fieldNames())),
        Sink(window_path, _partial_counts),
    ]
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return start_fan_out(
        detail(messages), sinks, marks, checkpoint, time="event_time", delay_seconds=WATERMARK_SECONDS, trigger=trigger
    )


PARTIAL_COUNT = T.StructType([*WINDOW_COUNT.fields, T.StructField("late", T.BooleanType())])


def _partial_counts(rows: DataFrame, watermark: Column) -> DataFrame:
    counted = rows.groupBy(F.window("event_time", WINDOW).alias("w"), "device_id").agg(F.count(F.lit(1)).alias("event_count"))
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "device_id",
        "event_count",
        F.coalesce(F.unix_micros("w.end") <= watermark, F.lit(False)).alias("late"),
    )


def read_detail(spark: SparkSession, detail_path: str, marks: str) -> DataFrame:
    """The detail table of ``start_two_sinks``, late rows included."""
    return read_sink(spark, detail_path, marks, DEVICE_EVENT).select(*DEVICE_EVENT.fieldNames())


def window_report(spark: SparkSession, window_path: str, marks: str) -> DataFrame:
    """Per closed window and device: all rows, rows counted, rows that came after the window had closed.

    A window is closed when the watermark of the last finished batch has passed its end.
    """
    closed = read_marks(spark, marks).agg((F.max("latest") - F.lit(WATERMARK_SECONDS * 1_000_000)).alias("at")).scalar()
    keys = ["window_start", "window_end", "device_id"]
    partial = read_sink(spark, window_path, marks, PARTIAL_COUNT).where(F.unix_micros("window_end") <= closed)
    sums = partial.groupBy(*keys).agg(
        F.sum("event_count").alias("detail_count"),
        F.sum(F.when(F.col("late"), F.lit(0).cast("long")).otherwise(F.col("event_count"))).alias("window_count"),
    )
    return sums.withColumn("late_count", F.col("detail_count") - F.col("window_count"))


def read_windows(spark: SparkSession, window_path: str, marks: str) -> DataFrame:
    """The window table of ``start_two_sinks``: closed windows with the rows that came in time."""
    counted = window_report(spark, window_path, marks).where("window_count > 0")
    return counted.select("window_start", "window_end", "device_id", F.col("window_count").alias("event_count"))


def start_split(
    events: DataFrame,
    on_time_path: str,
    late_path: str,
    marks: str,
    checkpoint: str,
    *,
    available_now: bool = False,
    interval: str = COMMIT_INTERVAL,
    one_file: bool = False,
) -> StreamingQuery:
    """Events in time to one folder, events behind the watermark to another, nothing to none.

    ``one_file`` puts the events in time of a batch into a single file, for
    batches that admission control keeps small, see ``start_deduplicated``.
    """
    kept = events.columns

    def in_time(rows: DataFrame, _: Column) -> DataFrame:
        own = rows.where("not late").select(*kept)
        return own.coalesce(1) if one_file else own

    sinks = [
        Sink(on_time_path, in_time),
        Sink(late_path, lambda rows, _: rows.where("late").select(*kept)),
    ]
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return start_fan_out(events, sinks, marks, checkpoint, time="event_time", delay_seconds=WATERMARK_SECONDS, trigger=trigger)


def start_deduplicated(
    spark: SparkSession,
    on_time_path: str,
    path: str,
    checkpoint: str,
    *,
    key: str = "event_id",
    available_now: bool = False,
    interval: str = COMMIT_INTERVAL,
    one_file: bool = False,
) -> StreamingQuery:
    """Each event once, from the folder of events in time.

    Keys are kept for the watermark delay only.  That is enough: a repeat that
    comes later is behind the watermark and in the other folder of
    ``start_split``.  No event in time is dropped here, as this stream takes
    whole batches of the first one in their order, so its watermark is never
    ahead of theirs: all that are there, or with ``one_file`` (as in
    ``start_split``) one batch per trigger.  A part of a batch would not do.
    """
    options = admission(files=1 if one_file else None)
    events = spark.readStream.schema(DEVICE_EVENT).options(**options).parquet(f"{on_time_path.rstrip('/')}/{BATCH}=*")
    once = deduplicated(events.select(*DEVICE_EVENT.fieldNames()), key)
    return start_append(once, path, checkpoint, available_now=available_now, interval=interval)


def late_events(spark: SparkSession, late_path: str, marks: str, distinct: DataFrame, key: str = "event_id") -> DataFrame:
    """Each late event once, without those that had also come in time."""
    rows = read_sink(spark, late_path, marks, DEVICE_EVENT).select(*DEVICE_EVENT.fieldNames())
    rest = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")
    return rows_not_in(once, distinct, [key])


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait until an available-now query has ended; raises what it raised."""
    query.awaitTermination()
    return query
