"""Schema contracts: ``name TYPE`` lines checked row by row, and their registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.names import (
    IDENTIFIER,
    SPACE,
    base_type,
    catalog_length,
    length_fits,
    catalog_type,
    contract_type_pattern,
    lines,
    parse_table_name,
    strip,
)
from tarnwork.functions.once import let, with_once

BAD_FORMAT = "expected name and type"
BAD_NAME = "invalid column name"
BAD_TYPE = "unsupported type"
BAD_LENGTH = "length out of range"
NO_COLUMNS = "at least one column is required"

# Lake tables of this project carry money columns; see README.
EXTRA_TYPES = ("DECIMAL",)


def parsed_lines(text: Column, extra_types: tuple[str, ...] = ()) -> Column:
    """array<struct(line_no, name, type, error)> of the non-blank lines of a contract."""
    two_words = rf"^([^\t-\r\x1c-\x20\x85\p{{Z}}]+){SPACE}+((?s:.+))\z"
    type_pattern = contract_type_pattern(extra_types)

    def verdict(word: Column, line_no: Column, text: Column) -> Column:
        error = (
            F.when(word["name"] == "", F.lit(BAD_FORMAT))
            .when(~word["name"].rlike(IDENTIFIER), F.lit(BAD_NAME))
            .when(~word["type"].rlike(type_pattern), F.lit(BAD_TYPE))
            .when(~length_fits(word["type"]), F.lit(BAD_LENGTH))
        )
        return F.struct(
            line_no.alias("line_no"),
            F.nullif(text, F.lit("")).alias("text"),
            word["name"].alias("name"),
            word["type"].alias("type"),
            error.alias("error"),
        )

    def words(text: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, two_words, 1).alias("name"),
            F.upper(strip(F.regexp_extract(text, two_words, 2))).alias("type"),
        )

    def check(line: Column, index: Column) -> Column:
        return let(strip(line), lambda text: let(words(text), lambda word: verdict(word, index + 1, text)))

    return F.filter(F.transform(lines(strip(text)), check), lambda row: row["text"].isNotNull())


def check_contracts(df: DataFrame, text: str, extra_types: tuple[str, ...] = EXTRA_TYPES) -> DataFrame:
    """Adds ``columns`` (the checked lines) and ``error``: the first bad line, or no line at all.

    All work stays within the row: a contract is never split over rows to be
    grouped again.
    """
    checked = with_once(df, "columns", parsed_lines(F.coalesce(F.col(text), F.lit("")), extra_types))
    first_bad = F.try_element_at(F.filter("columns", lambda c: c["error"].isNotNull()), F.lit(1))
    return checked.withColumn(
        "error",
        F.when(
            F.size("columns") == 0,
            F.struct(F.lit(None).cast("int").alias("line_no"), F.lit(NO_COLUMNS).alias("reason")),
        ).when(first_bad.isNotNull(), F.struct(first_bad["line_no"].alias("line_no"), first_bad["error"].alias("reason"))),
    )


def accepted_columns(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, name, type) of all columns of the contracts without error."""
    return (
        checked.where(F.col("error").isNull())
        .select(*keys, F.posexplode("columns").alias("__pos", "__c"))
        .select(*keys, (F.col("__pos") + 1).alias("position"), F.col("__c.name").alias("name"), F.col("__c.type").alias("type"))
    )


def rejected_contracts(checked: DataFrame, keys: list[str]) -> DataFrame:
    return checked.where(F.col("error").isNotNull()).select(*keys, "error.line_no", "error.reason")


def catalog_columns(columns: DataFrame) -> DataFrame:
    """Catalogue type and length for accepted contract columns."""
    kind = F.col("type")
    return columns.withColumns(
        {"base_type": base_type(kind), "catalog_type": catalog_type(kind), "data_length": catalog_length(kind)}
    )


def registration_rows(requests: DataFrame, now: Column, extra_types: tuple[str, ...] = EXTRA_TYPES) -> DataFrame:
    """Audit rows of table registrations: the verdict on name and columns of every request.

    ``requests``: id, requested_by, table_fqn, owner, security_level, columns_raw.
    """
    named = requests.withColumn("__name", parse_table_name(F.col("table_fqn")))
    checked = check_contracts(named, "columns_raw", extra_types)
    note = F.coalesce(F.col("__name.error"), F.col("error.reason"))
    status = F.when(note.isNull(), F.lit("created")).otherwise(F.lit("rejected"))
    return checked.select(
        "id",
        "requested_by",
        F.when(F.col("__name.error").isNull(), F.concat_ws(".", "__name.catalog", "__name.schema", "__name.table"))
        .otherwise(F.col("table_fqn"))
        .alias("table_fqn"),
        "owner",
        "security_level",
        "columns_raw",
        status.alias("table_status"),
        F.when(note.isNull(), F.lit("registered")).otherwise(F.lit("skipped")).alias("catalog_status"),
        note.alias("note"),
        now.alias("created_at"),
    )
