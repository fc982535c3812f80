"""Container log files as labelled lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.labels import pod_log_labels


def relabel(lines: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """Labels from the file path, in front of the line text."""
    others = [c for c in lines.columns if c not in (path, line)]
    return lines.select(pod_log_labels(F.col(path)).alias("__l"), *others, line).select("__l.*", *others, line)


def read_pod_logs(spark: SparkSession, root: str, streaming: bool = False) -> DataFrame:
    """(namespace, pod, container, job, line) of all files ``<root>/*/*/*.log``."""
    reader = spark.readStream if streaming else spark.read
    text = reader.text(f"{root.rstrip('/')}/*/*/*.log")
    return relabel(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))
