"""One read of a stream, several sinks, and what each micro-batch has seen.

``start_fan_out`` hands every micro-batch to all sinks.  A sink keeps the rows
of a batch in a folder of its own, ``batch=<number>``, which a batch that runs
again replaces; so a failure between two sinks, or after them, leaves neither
lost nor repeated rows in any of them.  When all sinks have a batch, its mark is
written: row counts and the latest event time so far.  Readers take the batches
up to the last mark, so they see a batch in all sinks or in none.

The mark of the batch before also gives the watermark: rows behind it are
``late``, in the same way whenever the batch runs.  Counts and latest time come
from an observation on the write of the first sink, not from another scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"
MARK = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("late_rows", T.LongType()),
        T.StructField("latest", T.LongType()),  # microseconds, over this and all earlier batches
        T.StructField("watermark", T.LongType()),  # what the batch was judged by
    ]
)


@dataclass(frozen=True)
class Sink:
    """A folder and what it gets of a batch, whose rows have the column ``late`` and come with the watermark in microseconds (or null)."""

    path: str
    rows: Callable[[DataFrame, F.Column], DataFrame]


def folder_of(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{BATCH}={number}"


def start_fan_out(
    stream: DataFrame, sinks: list[Sink], marks: str, checkpoint: str, *, time: str, delay_seconds: int, trigger: dict
) -> StreamingQuery:
    """Write every micro-batch to all sinks, then its mark to the folder ``marks``."""

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _mark(spark, marks, number - 1) if number else None
        latest = before.latest if before else None
        watermark = None if latest is None else latest - delay_seconds * 1_000_000
        limit = F.lit(watermark).cast("long")
        late = F.coalesce(F.unix_micros(time) < limit, F.lit(False))
        rows = batch.withColumn("late", late).persist()
        try:
            seen = Observation()
            counted = rows.observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.count_if("late").alias("late_rows"),
                F.max(F.unix_micros(time)).alias("latest"),
            )
            for place, sink in enumerate(sinks):
                sink.rows(rows if place else counted, limit).write.mode("overwrite").parquet(folder_of(sink.path, number))
            found = seen.get
        finally:
            rows.unpersist()
        times = [t for t in (latest, found["latest"]) if t is not None]
        mark = (found["rows"], found["late_rows"], max(times) if times else None, watermark)
        spark.createDataFrame([mark], MARK).coalesce(1).write.mode("overwrite").parquet(folder_of(marks, number))

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _mark(spark: SparkSession, marks: str, number: int):
    return spark.read.schema(MARK).parquet(folder_of(marks, number)).first()


def read_marks(spark: SparkSession, marks: str) -> DataFrame:
    """One row per finished batch, with its number in the column ``batch``."""
    return spark.read.schema(T.StructType([*MARK.fields, T.StructField(BATCH, T.LongType())])).parquet(marks)


def read_sink(spark: SparkSession, path: str, marks: str, schema: T.StructType) -> DataFrame:
    """Rows of all finished batches, with ``batch``; folders behind the last mark are not opened."""
    last = read_marks(spark, marks).agg(F.max(BATCH).alias("last")).first().last
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)
    return rows.where(F.col(BATCH) <= F.lit(-1 if last is None else last))


# ---- what a query reports of itself -------------------------------------------


class ProgressLost(RuntimeError):
    pass


def progress_counts(query: StreamingQuery, observed: str | None = None) -> dict[str, int]:
    """Input rows of all batches of a run, and the sums of an observation, from the progress the query kept.

    The session keeps the last ``spark.sql.streaming.numRecentProgressUpdates``
    batches; a run with more of them is an error here and not a smaller count.
    """
    reports: dict = {}
    for report in query.recentProgress:  # an idle trigger reports the number of the batch to come
        known = reports.get(report["batchId"])
        if known is None or report["numInputRows"] >= known["numInputRows"]:
            reports[report["batchId"]] = report
    numbers = sorted(reports)
    limit = int(query._jsq.sparkSession().conf().get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(query.recentProgress) >= limit or numbers != list(range(numbers[0], numbers[0] + len(numbers)) if numbers else []):
        raise ProgressLost(f"the query kept the progress of {len(numbers)} batches only")
    counts = {"input_rows": sum(p["numInputRows"] for p in reports.values())}
    for report in reports.values():
        found = report["observedMetrics"].get(observed) if observed else None
        for name, value in (found.asDict() if found else {}).items():
            counts[name] = counts.get(name, 0) + (value or 0)
    return counts
