"""Catalogue entities, search, scan differences, inventory and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.names import schema_of
from tarnwork.operators.keyed import rows_not_in
from tarnwork.sources.tables import describe, parse_documents
from tarnwork import schemas

# ---- fixed values: how the catalogue marks levels and lake sinks -----------
LEVEL_TAG = "SecurityLevel.Level"
LEVEL_WORD = "Level"
LAKE_SINK = "Iceberg"
CATALOG_PREFIX = "trino.iceberg"
# ---------------------------------------------------------------------------


def governance(doc: Column) -> tuple[Column, Column]:
    """(security level, owner) of a catalogue entity.

    The last readable level tag counts, then the extension; the first owner of
    type user counts, then the registered owner of the extension.
    """
    level_tags = F.filter(doc["tags"], lambda t: t["tagFQN"].startswith(LEVEL_TAG))
    levels = F.transform(
        level_tags, lambda t: F.element_at(F.split(t["tagFQN"], LEVEL_WORD), -1).try_cast("int")
    )
    readable = F.filter(levels, lambda n: n.isNotNull())
    level = F.coalesce(F.try_element_at(readable, F.lit(-1)), doc["extension"]["securityLevel"])
    users = F.filter(doc["owners"], lambda o: o["type"] == "user")
    owner = F.coalesce(F.try_element_at(users, F.lit(1))["name"], doc["extension"]["registeredOwner"])
    return level, owner


def entity_rows(documents: DataFrame, column: str = "doc_json") -> DataFrame:
    """(fqn, schema, security_level, owner, columns) per catalogue document."""
    parsed = parse_documents(documents, column, schemas.CATALOG_ENTITY)
    level, owner = governance(F.col("doc"))
    fqn = F.coalesce(F.col("doc.fullyQualifiedName"), F.lit(""))
    return parsed.select(
        fqn.alias("fqn"),
        schema_of(fqn).alias("schema"),
        level.alias("security_level"),
        owner.alias("owner"),
        F.transform("doc.columns", lambda c: c["name"]).alias("columns"),
    )


def search(entities: DataFrame, keyword: str = "", schema: str = "", level: int | None = None, limit: int = 200) -> DataFrame:
    """Catalogue page: keyword (any case), schema and level, by name."""
    found = entities
    if keyword:
        found = found.where(F.contains(F.lower("fqn"), F.lit(keyword.lower())))
    if schema:
        found = found.where(F.col("schema") == schema)
    if level is not None:
        found = found.where(F.col("security_level") == level)
    return found.orderBy("fqn").limit(limit)


def scan_difference(before: DataFrame, after: DataFrame, key: str = "table_name", signature: str = "signature") -> DataFrame:
    """(key, change) with change new, changed or deleted between two catalogue scans."""
    old = before.select(key, F.col(signature).alias("__old"), F.lit(True).alias("__was"))
    new = after.select(key, F.col(signature).alias("__new"), F.lit(True).alias("__is"))
    change = (
        F.when(F.col("__was").isNull(), F.lit("new"))
        .when(F.col("__is").isNull(), F.lit("deleted"))
        .when(~F.col("__old").eqNullSafe(F.col("__new")), F.lit("changed"))
    )
    return old.join(new, key, "full").select(key, change.alias("change")).where(F.col("change").isNotNull())


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, data_type, row_count) of all given tables."""
    columns = reduce(DataFrame.unionByName, [describe(df, name) for name, df in tables.items()])
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
            for name, df in tables.items()
        ],
    )
    return columns.join(counts, "table_name")


def sink_tables(runs: DataFrame, pipeline: str = "pipeline_id", config: str = "config_json") -> DataFrame:
    """Distinct (pipeline, table_fqn) of the lake sinks in job configurations.

    Equal configurations of a pipeline are dropped first, so every one of
    them is parsed once, however often it ran.
    """
    parsed = parse_documents(runs.select(pipeline, config).distinct(), config, schemas.JOB_CONFIG)
    sinks = F.filter("doc.sink", lambda s: s["plugin_name"] == LAKE_SINK)
    return (
        parsed.select(pipeline, F.explode(sinks).alias("s"))
        .select(pipeline, F.concat_ws(".", F.lit(CATALOG_PREFIX), "s.namespace", "s.table").alias("table_fqn"))
        .distinct()
    )


def lineage_edges(sinks: DataFrame, known_tables: DataFrame, pipeline: str = "pipeline_id") -> DataFrame:
    """(pipeline, table_fqn, table_id) for sink tables the catalogue knows."""
    ids = known_tables.select("table_fqn", "table_id").distinct()
    return sinks.join(ids, "table_fqn").select(pipeline, "table_fqn", "table_id")


def unresolved_sinks(sinks: DataFrame, known_tables: DataFrame) -> DataFrame:
    return rows_not_in(sinks, known_tables, ["table_fqn"])
