"""Data-quality gates as one-row frames, and the raising form of the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptySource(RuntimeError):
    pass


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """The frame itself, or an error when it has no row (reads one row at most)."""
    if df.isEmpty():
        raise EmptySource(f"{name} is empty")
    return df


def nonempty(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("passed", F.col("row_count") > 0)


def group_count(df: DataFrame, column: str, expected: int) -> DataFrame:
    return df.agg(F.count_distinct(F.col(column)).alias("group_count")).withColumn(
        "passed", F.col("group_count") == F.lit(expected)
    )


def count_grew(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of two states of a table and whether the later one is larger."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit(name))
        for name, df in (("before", before), ("after", after))
    ]
    n = lambda name: F.coalesce(F.max(F.when(F.col("state") == name, F.col("n"))), F.lit(0))
    return counts[0].unionByName(counts[1]).agg(
        n("before").alias("before_count"), n("after").alias("after_count")
    ).withColumn("passed", F.col("after_count") > F.col("before_count"))


def growth(spark: SparkSession, runs: list[dict[str, int]]) -> DataFrame:
    """Whether the last of several runs added rows, from the counts the runs reported (``messages``, ``events``, ``input_rows``)."""
    before = sum(r.get("events", 0) for r in runs[:-1])
    after = before + runs[-1].get("events", 0)
    taken = sum(r["input_rows"] for r in runs)
    row = (before, after, taken, sum(r.get("messages", 0) for r in runs) - after, after > before)
    return spark.createDataFrame(
        [row], "before_count long, after_count long, input_rows long, unreadable_rows long, passed boolean"
    )


def missing_columns(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (table_name, column_name) pairs that a table lacks; case does not count."""
    keys = [F.col("table_name"), F.lower("column_name").alias("column_name")]
    return expected.select(*keys).distinct().join(
        actual.select(*keys).distinct(), ["table_name", "column_name"], "left_anti"
    )


def enough_to_train(df: DataFrame, label: str, min_rows: int = 4, min_classes: int = 2) -> DataFrame:
    """Row and class counts with the verdict of the training gate."""
    counted = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(F.col(label)).alias("class_count")
    )
    passed: Column = (F.col("row_count") >= min_rows) & (F.col("class_count") >= min_classes)
    return counted.withColumn("passed", passed)


class NotEnoughRows(RuntimeError):
    pass


def require_training(df: DataFrame, label: str, min_rows: int = 4, min_classes: int = 2) -> DataFrame:
    """The frame itself, or an error when the training gate does not pass (reads one row of counts)."""
    row = enough_to_train(df, label, min_rows, min_classes).first()
    if not row.passed:
        raise NotEnoughRows(f"{row.row_count} rows of {row.class_count} classes are too few to train on")
    return df
