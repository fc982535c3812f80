"""Registered queries and the SQL each is compared with.

A query is a function (spark, sf_dir) -> DataFrame.  Its SQL may name the
``v_*`` views of this package; ``full_sql`` puts those in front as CTEs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.session import configure, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEW_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(build(configure(spark), sf_dir.rstrip("/")))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


_STORED: dict[tuple[str, str, str], str] = {}


def stored_input(spark: SparkSession, name: str, tables: list[str], build: Callable[[str], None]) -> str:
    """Folder of a derived input, written by ``build`` once per application and state of the tables.

    The files of the tables (path, length, time of writing) are part of the
    key, so a changed table is derived again; only the path is kept.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    state = []
    for table in tables:
        folder = hadoop(table)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files = system.listFiles(folder, True)
        while files.hasNext():
            status = files.next()
            state.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, hashlib.sha256(repr(sorted(state)).encode()).hexdigest())
    if key not in _STORED:
        path = scratch_path(spark, name)
        build(path)
        _STORED[key] = path
    return _STORED[key]


def stored_bytes(spark: SparkSession, tables: list[str]) -> int:
    """Length of all files of some tables."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = lambda folder: folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(system(folder).getContentSummary(folder).getLength() for folder in map(hadoop, tables))


def plain_types(df: DataFrame) -> DataFrame:
    """Money as double and times without a zone, as the compared SQL returns them."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def full_sql(name: str) -> str:
    """SQL of a query with the views it needs."""
    text = SQL[name].strip()
    needed: list[str] = []

    def visit(part: str) -> None:
        for view in re.findall(r"\bv_\w+", part):
            if view in VIEW_SQL and view not in needed:
                visit(VIEW_SQL[view])
                if view not in needed:
                    needed.append(view)

    visit(text)
    ctes = [f"{view} AS ({VIEW_SQL[view].strip()})" for view in needed]
    if not ctes:
        return text
    if text[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text


def bucket_sql(column: str, seconds: int) -> str:
    width = seconds * 1_000_000
    return f"make_timestamp(epoch_us({column}) - epoch_us({column}) % {width})"


def hash_sql(key: str, salt: str, seed: int = 42) -> str:
    """The same number as functions.hashing.key_hash."""
    return f"CAST('0x' || substr(md5('{seed}:{salt}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
