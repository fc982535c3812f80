"""Staging and mart models, and the dashboard queries on them.

A model is a function from frames to a frame; a dependency is an argument.
Views stay lazy, marts are written by the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.schemas import ORDERS


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(*ORDERS.fieldNames())


def daily_order_totals(stg: DataFrame) -> DataFrame:
    return stg.groupBy("order_date", "region").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("amount").alias("total_amount")
    )


def orders_by_region(stg: DataFrame) -> DataFrame:
    return stg.groupBy("region").agg(F.sum("amount").alias("total_amount"))


def region_chart(stg: DataFrame, row_limit: int = 100) -> DataFrame:
    """The chart's page of region totals, largest first."""
    return orders_by_region(stg).orderBy(F.desc("total_amount"), "region").limit(row_limit)


def distinct_count(df: DataFrame, column: str, out: str, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(counter(F.col(column)).alias(out))


def first_rows(df: DataFrame, order: list[str], limit: int, ascending: bool = True) -> DataFrame:
    """A page of rows by a unique order; only the page leaves each task."""
    columns = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
    return df.orderBy(*columns).limit(limit)
