"""Batch sinks: append, full refresh, create-or-replace, versioned snapshots.

Tables are Parquet.  Plain Parquet tables have no row-level delete, so a
refresh is an overwrite and an upsert writes a new snapshot version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows; running it again adds them again."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_by_date(df: DataFrame, path: str, time: str, date_column: str = "event_date") -> None:
    """Add rows to a table partitioned by the date of ``time``.

    The rebalance lets AQE write few files per day and split a day that has
    most of the rows.
    """
    dated = df.withColumn(date_column, F.to_date(time)).hint("rebalance", date_column)
    append(dated, path, partition_by=[date_column])


def full_refresh(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace all rows; running it again gives the same table.

    The rows go to a folder beside ``path`` and take its place when they are
    complete, so the frame may read the table it replaces and a failed run
    changes nothing.  Between the two renames a reader may find no folder;
    ``refresh``, which keeps versions, has no such moment.
    """
    spark = df.sparkSession
    target = path.rstrip("/")
    fresh, old = (f"{target}.{mark}-{uuid.uuid4().hex[:12]}" for mark in ("new", "old"))
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = fs.exists(hadoop_path(target))
    if replaced and not fs.rename(hadoop_path(target), hadoop_path(old)):
        raise OSError(f"cannot move {target} aside; the new rows are in {fresh}")
    if not fs.rename(hadoop_path(fresh), hadoop_path(target)):
        if replaced:
            fs.rename(hadoop_path(old), hadoop_path(target))
        raise OSError(f"cannot move {fresh} to {target}")
    if replaced:
        fs.delete(hadoop_path(old), True)
    spark.catalog.refreshByPath(target)


def refresh(df: DataFrame, root: str, keep: int = 2) -> int:
    """Replace all rows at every moment: a new version beside the old one, which readers of ``read_snapshot`` see when it is complete.

    A failed run changes nothing, the frame may read the table it replaces, and
    the ``keep`` newest versions stay for readers that are still at work.
    """
    spark = df.sparkSession
    versions = snapshot_versions(spark, root)
    number = (versions[-1] if versions else 0) + 1
    publish_snapshot(df, root, number)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [*versions, number][:-keep]:
        fs.delete(hadoop_path(f"{root.rstrip('/')}/version={old:012d}"), True)
    return number


def create_schema(spark: SparkSession, schema: str, location: str | None = None) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_quoted(schema)}{_location(location)}")


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None) -> None:
    """Create an empty Parquet table unless it exists."""
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING parquet{_location(location)}")


def insert_into(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """Add rows to a table by column name."""
    columns = df.sparkSession.table(name).columns
    df.select(*columns).write.insertInto(name, overwrite=overwrite)


def create_or_replace(df: DataFrame, name: str, root: str) -> DataFrame:
    """Create or replace a table from a frame and read it back.

    The rows go to a new folder below ``root``; the table is pointed there
    when they are complete.  The frame may read the table it replaces.  With
    the same names and types readers see the old or the new rows at any time,
    and a failed run changes nothing; other columns take a drop and a create,
    between which the table is missing.  Old folders stay below ``root`` for
    readers that are still at work.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark.catalog.tableExists(name) and _shape(spark.table(name).schema) == _shape(df.schema):
        spark.sql(f"ALTER TABLE {_quoted(name)} SET{_location(path)}")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
        create_table(spark, name, df.schema, path)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    """Names and types without nullability, which a stored table does not keep."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def write_messages(messages: DataFrame, *, path: str | None = None, kafka: dict[str, str] | None = None) -> None:
    """Send keyed messages to the log: a Kafka topic, or a folder of JSON lines.

    ``kafka`` holds the writer options (servers, ``topic``).
    """
    if kafka:
        messages.select("key", "value").write.format("kafka").options(**kafka).save()
    else:
        messages.select("value").write.mode("append").text(path)


def write_messages_in_order(messages: DataFrame, order: str, path: str, staging: str, files: int = 1) -> None:
    """Send messages to a folder of JSON lines slice by slice, in the ascending order of the column ``order``.

    A file source takes files by their time of writing, so a log written like
    this is read in its own order, however few files a trigger takes.  The rows
    are put into one folder per slice first, which each later write opens alone.
    ``order`` should have few values: they come to the driver, one write each.
    """
    messages.select(F.col(order).alias("__slice"), "value").write.partitionBy("__slice").parquet(staging)
    spark = messages.sparkSession
    kind = T.StructType([T.StructField("value", T.StringType()), T.StructField("__slice", messages.schema[order].dataType)])
    staged = spark.read.schema(kind).parquet(staging)
    slices = staged.select("__slice").distinct().orderBy("__slice").collect()
    if not slices:  # an empty log is a folder as well
        staged.select("value").write.mode("append").text(path)
    for row in slices:
        part = staged.where(F.col("__slice").eqNullSafe(F.lit(row["__slice"])))
        part.select("value").coalesce(files).write.mode("append").text(path)


def _location(path: str | None) -> str:
    return " LOCATION '" + path.replace("'", "\\'") + "'" if path else ""


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def publish_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write one snapshot version; readers see it when its success mark exists."""
    path = f"{root.rstrip('/')}/version={version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions below a snapshot root, oldest first.

    Lists one folder: its size is the number of versions, not of rows.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest finished snapshot, or a named one."""
    versions = snapshot_versions(spark, root)
    if version is None:
        if not versions:
            raise FileNotFoundError(f"no finished snapshot in {root}")
        version = versions[-1]
    return spark.read.parquet(f"{root.rstrip('/')}/version={version:012d}")
