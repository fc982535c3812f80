"""Variants of the driver tables: no rows, and one key with a third of all rows."""

from __future__ import annotations

import os

import duckdb

# Key columns that get one value in every third row.
HOT = {
    "orders": {"o_custkey": 7},
    "lineitem": {"l_orderkey": 11, "l_suppkey": 3, "l_linenumber": 1},
    "events": {"user_id": 7},
    "customer": {"c_mktsegment": "'BUILDING'"},
    "part": {"p_brand": "'Brand#1'"},
}


def variant(sf_dir: str, out_dir: str, kind: str) -> str:
    """Write a copy of all tables below ``out_dir`` and return its folder."""
    target = os.path.join(out_dir, kind)
    os.makedirs(target)
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        source = f"'{sf_dir}/{name}'"
        if kind == "empty":
            sql = f"SELECT * FROM {source} LIMIT 0"
        else:
            hot = ", ".join(
                f"CASE WHEN rn % 3 = 0 THEN {value} ELSE {column} END::{_type(con, source, column)} AS {column}"
                for column, value in HOT.get(table, {}).items()
            )
            rows = f"(SELECT *, row_number() OVER () AS rn FROM {source})"
            sql = f"SELECT * EXCLUDE (rn){f' REPLACE ({hot})' if hot else ''} FROM {rows}"
        con.execute(f"COPY ({sql}) TO '{target}/{name}' (FORMAT parquet)")
    return target


def _type(con, source: str, column: str) -> str:
    return dict((r[0], r[1]) for r in con.execute(f"DESCRIBE SELECT * FROM {source}").fetchall())[column]
