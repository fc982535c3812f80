"""Device events: synthetic rows, the message log and its tolerant decoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.hashing import key_fraction, key_hash, pick
from tarnwork.functions.once import with_once
from tarnwork.functions.times import iso_millis
from tarnwork.schemas import DEVICE_EVENT

# ---- fixed values: the device fleet of the demo stream ---------------------
DEVICE_COUNT = 10
EVENT_TYPES = ["heartbeat", "temperature", "humidity", "battery", "error"]
# ---------------------------------------------------------------------------

CORRUPT = "_corrupt_record"


def synthetic_rows(ids: DataFrame, id_column: str, schema: T.StructType, seed: int = 42) -> DataFrame:
    """One row of the declared schema per id; a value depends on (id, column, seed) only.

    ``ids`` may be ``spark.range(n)`` or any frame with a unique id, so rows
    are produced where the ids are and nothing is made on the driver.
    """
    return ids.select(*[_value(F.col(id_column), f, seed).alias(f.name) for f in schema.fields])


def _value(key: Column, field: T.StructField, seed: int) -> Column:
    number = key_hash(key, field.name, seed)
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return F.concat(F.lit(f"{field.name}-"), number.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return key_fraction(key, field.name, seed).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(number)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date((number % F.lit(36_500)).cast("int"))
    if isinstance(kind, T.BooleanType):
        return number % 2 == 0
    if isinstance(kind, T.DecimalType):
        whole = min(kind.precision - kind.scale, 9)
        return (number % F.lit(10**whole)).cast(kind)
    if isinstance(kind, T.LongType):
        return number
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        top = {T.IntegerType: 1 << 31, T.ShortType: 1 << 15, T.ByteType: 1 << 7}[type(kind)]
        return (number % F.lit(top)).cast(kind)
    raise TypeError(f"no synthetic values for {kind.simpleString()}")


def device_events(ids: DataFrame, id_column: str, event_time: Column, devices: int = DEVICE_COUNT, seed: int = 42) -> DataFrame:
    """Device readings: a device, an event type and a value in [0, 100] with two places."""
    key = F.col(id_column)
    hundredths = key_hash(key, "value", seed) % F.lit(10_001)
    device = key_hash(key, "device", seed) % F.lit(devices) + 1
    return ids.select(
        key.cast("long").alias("event_id"),
        F.format_string("device-%03d", device).alias("device_id"),
        pick(key, "type", EVENT_TYPES, seed).alias("event_type"),
        (hundredths / F.lit(100.0)).alias("value"),
        event_time.alias("event_time"),
    )


def live_device_events(spark: SparkSession, rows_per_second: int = 4, devices: int = DEVICE_COUNT) -> DataFrame:
    """The same readings as an unbounded stream."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return device_events(ticks, "value", F.col("timestamp"), devices)


def encode_messages(events: DataFrame) -> DataFrame:
    """Keyed JSON messages (key = device, value = JSON text, ISO-8601 time with Z)."""
    body = F.to_json(
        F.struct("event_id", "device_id", "event_type", "value", iso_millis(F.col("event_time")).alias("event_time"))
    )
    return events.select(F.col("device_id").alias("key"), body.alias("value"))


def admission(files: int | None = None, max_bytes: int | None = None) -> dict[str, str]:
    """Reader options that bound what one trigger takes from a folder, so a backlog is worked off in many small batches."""
    options = {"maxFilesPerTrigger": files, "maxBytesPerTrigger": max_bytes}
    return {name: str(value) for name, value in options.items() if value is not None}


def read_messages(spark: SparkSession, *, path: str | None = None, kafka: dict[str, str] | None = None, **options) -> DataFrame:
    """The message log as a stream with a text column ``value``.

    ``kafka`` holds the reader options (servers, ``subscribe``); reading starts
    at the earliest offset.  ``path`` is a folder of JSON-lines files for
    places without the Kafka connector.  ``options`` may bound a trigger:
    ``admission`` for a folder, ``maxOffsetsPerTrigger`` for a topic.  Windows
    and watermarks need a log in the order of time then, as a topic has it and
    as ``write_messages_in_order`` writes a folder.
    """
    if kafka:
        reader = spark.readStream.format("kafka").option("startingOffsets", "earliest").options(**kafka, **options)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.format("text").options(**options).load(path)


def decode_messages(messages: DataFrame, column: str = "value", schema: T.StructType = DEVICE_EVENT) -> DataFrame:
    """Decode JSON without failing: a bad field gives a null field.

    Adds ``readable``, false for text that is no JSON object (no field at all
    could be read).
    """
    with_mark = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    names = [f.name for f in schema.fields]
    rows = with_once(messages.select(F.col(column).alias("raw")), "__e", _parsed("raw", with_mark)).select("raw", "__e.*")
    nothing_read = F.lit(True)
    for name in names:
        nothing_read = nothing_read & F.col(name).isNull()
    readable = F.col("raw").isNotNull() & ~(F.col(CORRUPT).isNotNull() & nothing_read)
    return rows.select("raw", *names, readable.alias("readable"))


def _parsed(column: str, schema: T.StructType) -> Column:
    return F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def valid_events(decoded: DataFrame, time: str = "event_time") -> DataFrame:
    """Rows with an event time, which are readable for that reason; single bad fields stay null."""
    return decoded.where(F.col(time).isNotNull()).drop("raw", "readable")


def quarantined(decoded: DataFrame, time: str = "event_time") -> DataFrame:
    """(raw, reason) of the rows that ``valid_events`` leaves out."""
    return decoded.where(~F.col("readable") | F.col(time).isNull()).select(
        "raw", F.when(~F.col("readable"), F.lit("not json")).otherwise(F.lit("no event time")).alias("reason")
    )
