"""Appends that happen once: rows are known by a key of their transition, runs by a commit mark.

A run writes its rows to a folder of its own and then its mark.  The same run
again finds the mark and does nothing; a run that failed before its mark is
written anew; another run that brings a transition again leaves that row out.
So neither a retry nor an overlapping schedule adds a row twice.  One writer at
a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.operators.keyed import rows_not_in

RUN, MONTH = "append_run", "append_month"
_MARK = T.StructType([T.StructField("appended", T.LongType())])


def append_once(rows: DataFrame, root: str, run: str, keys: list[str], time: str) -> int | None:
    """Add the rows whose ``keys`` no earlier run has added; the number of them, or nothing if the run had been there.

    ``time`` belongs to the transition: only the stored months that the new rows
    fall into are read.  Rows that repeat a key within the run count once, the
    least of them; rows without a time have a month of their own.
    """
    spark = rows.sparkSession
    name = _run_name(run)
    if name in _finished(spark, root):
        return None
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*")
    fresh = once.select(*rows.columns).withColumn(MONTH, F.coalesce(F.trunc(time, "month"), F.lit("1900-01-01").cast("date"))).persist()
    try:
        months = fresh.agg(F.min(MONTH).alias("first"), F.max(MONTH).alias("last")).first()
        if _finished(spark, root):
            known = _stored(spark, root, rows.schema).where(F.col(MONTH).between(months.first, months.last))
            # As a struct, keys with a null part are equal as well.
            key = F.struct(*keys)
            fresh_only = rows_not_in(fresh.withColumn("__key", key), known.select(key.alias("__key")), ["__key"]).drop("__key")
        else:
            fresh_only = fresh
        folder = f"{root.rstrip('/')}/rows/{RUN}={name}"
        fresh_only.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(folder)
    finally:
        fresh.unpersist()
    written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(MONTH, T.DateType())])).parquet(folder)
    count = written.agg(F.count(F.lit(1)).alias("appended"))
    count.write.mode("overwrite").parquet(f"{root.rstrip('/')}/marks/{RUN}={name}")
    return count.first().appended


def read_once(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all finished runs."""
    return _stored(spark, root, schema).select(*schema.fieldNames())


def _stored(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    inside = [T.StructField(RUN, T.StringType()), T.StructField(MONTH, T.DateType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *inside])).parquet(f"{root.rstrip('/')}/rows")
    marks = spark.read.schema(T.StructType([*_MARK.fields, inside[0]])).parquet(f"{root.rstrip('/')}/marks")
    return rows.join(marks.select(RUN), RUN, "left_semi")


def _finished(spark: SparkSession, root: str) -> set[str]:
    """Names of the runs with a finished mark: one folder is listed, not its rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{root.rstrip('/')}/marks")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return set()
    runs = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith(f"{RUN}=")]
    return {p.getName().split("=", 1)[1] for p in runs if system.exists(path(p, "_SUCCESS"))}


def _run_name(run: str) -> str:
    """A name that is safe in a path and different for different runs."""
    return "r" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in run)
