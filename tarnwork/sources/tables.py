"""Batch scans, SQL text, inline rows, CSV and JSON documents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork import schemas
from tarnwork.functions.once import with_once


def scan(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalogue table, or a Parquet path when the name has a slash."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df


def run_sql(
    spark: SparkSession, text: str, catalog: str | None = None, schema: str | None = None, **tables: DataFrame
) -> DataFrame:
    """SQL text to a lazy DataFrame.

    ``catalog`` and ``schema`` hold for the names of this text only.  Keyword
    arguments are visible as ``{name}``, so no view of the session is created.
    """
    before = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    try:
        if catalog:
            spark.catalog.setCurrentCatalog(catalog)
        if schema:
            spark.catalog.setCurrentDatabase(schema)
        return spark.sql(text, **tables) if tables else spark.sql(text)
    finally:
        if catalog or schema:
            spark.catalog.setCurrentCatalog(before[0])
            spark.catalog.setCurrentDatabase(before[1])


def row_count(df: DataFrame, out: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def values_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: T.StructType | str) -> DataFrame:
    """Inline constant rows under a declared schema."""
    return spark.createDataFrame(list(rows), schema)


def describe(df: DataFrame, table: str) -> DataFrame:
    """(table_name, position, column_name, data_type) of a frame, from its schema alone."""
    rows = [(table, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string"
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, columns found by name and cast to a declared schema.

    Types are never inferred.  A column the header lacks is null; a value that
    does not fit its type fails the load.  The files of a folder may have their
    columns in different orders: each is read by its own header.
    """
    parts = [_by_name(spark.read.option("header", True).csv(files), schema) for files in _by_header(spark, path)]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _by_name(raw: DataFrame, schema: T.StructType) -> DataFrame:
    present = set(raw.columns)
    return raw.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a folder in groups of the same first line; the driver gets file names and their first lines.

    Only the first block of a file is read for it.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0 AND length(value) > 0")
    numbered = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    first = numbered.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        groups.setdefault(row.header, []).append(row.file)
    return list(groups.values())


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.EMPLOYEES)


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """(username, group), both trimmed."""
    rows = read_csv(spark, path, schemas.MEMBERSHIPS)
    return rows.select(F.trim("username").alias("username"), F.trim("group").alias("group"))


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    """Grants with a blank expiry as empty text ("never expires")."""
    rows = read_csv(spark, path, schemas.GRANTS)
    return rows.withColumn("expires_at", F.coalesce("expires_at", F.lit("")))


def parse_documents(df: DataFrame, column: str, schema: T.StructType, out: str = "doc") -> DataFrame:
    """JSON documents in a text column to a struct column; null where unreadable."""
    return with_once(df, out, F.from_json(column, schema))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON document each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
