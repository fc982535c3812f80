"""Runs a registered query and its SQL and compares the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return _sorted_rows(names, cursor.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def type_family(name: str) -> str:
    name = name.lower()
    for family, starts in {
        "int": ("bigint", "int", "hugeint", "smallint", "tinyint"),
        "double": ("double", "float"),
        "text": ("string", "varchar"),
        "timestamp": ("timestamp",),
    }.items():
        if name.startswith(starts):
            return family
    return name


def difference(spark_result, sql_result) -> str | None:
    names, rows = spark_result
    sql_names, expected = sql_result
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if rows == expected:
        return None
    extra, missing = rows - expected, expected - rows
    return (
        f"{sum(rows.values())} rows, SQL {sum(expected.values())}; "
        f"only Spark {sum(extra.values())}: {list(extra)[:3]}; only SQL {sum(missing.values())}: {list(missing)[:3]}"
    )
