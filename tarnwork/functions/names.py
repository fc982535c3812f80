"""Column functions on table names, column contracts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: must equal the published contract rules -----------------
DEFAULT_CATALOG = "iceberg"
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*\z"
CONTRACT_TYPES = (
    "VARCHAR",
    "CHAR",
    "BIGINT",
    "INTEGER",
    "INT",
    "SMALLINT",
    "TINYINT",
    "DOUBLE",
    "REAL",
    "BOOLEAN",
    "DATE",
    "TIMESTAMP",
)
CATALOG_TYPES = {
    "VARCHAR": "VARCHAR",
    "CHAR": "CHAR",
    "BIGINT": "BIGINT",
    "INTEGER": "INT",
    "INT": "INT",
    "SMALLINT": "SMALLINT",
    "TINYINT": "TINYINT",
    "DOUBLE": "DOUBLE",
    "REAL": "FLOAT",
    "BOOLEAN": "BOOLEAN",
    "DATE": "DATE",
    "TIMESTAMP": "TIMESTAMP",
}
DEFAULT_TEXT_LENGTH = 255
# ---------------------------------------------------------------------------

# White space and line ends as the contract texts use them (Unicode, not ASCII).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+\z", "")


def lines(col: Column) -> Column:
    return F.split(col, LINE_END)


def name_parts(fqn: Column) -> Column:
    return F.split(fqn, r"\.")


def schema_table(fqn: Column) -> Column:
    """Last two parts of a dotted name; shorter names stay as they are."""
    parts = name_parts(fqn)
    return F.when(F.size(parts) < 2, fqn).otherwise(
        F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))
    )


def schema_of(fqn: Column) -> Column:
    """Second-last part, or an empty text when there is none."""
    return F.coalesce(F.try_element_at(name_parts(fqn), F.lit(-2)), F.lit(""))


def parse_table_name(fqn: Column, default_catalog: str = DEFAULT_CATALOG) -> Column:
    """struct(catalog, schema, table, error) for a two- or three-part name."""
    trimmed = strip(fqn)
    parts = name_parts(trimmed)
    size = F.size(parts)
    well_formed = size.isin(2, 3) & F.forall(parts, lambda p: p.rlike(IDENTIFIER))
    error = F.when(~size.isin(2, 3) | size.isNull(), F.lit("wrong number of name parts")).when(
        ~well_formed, F.lit("invalid name part")
    )
    catalog = F.when(size == 3, F.get(parts, F.lit(0))).otherwise(F.lit(default_catalog))
    return F.struct(
        F.when(well_formed, catalog).alias("catalog"),
        F.when(well_formed, F.try_element_at(parts, F.lit(-2))).alias("schema"),
        F.when(well_formed, F.try_element_at(parts, F.lit(-1))).alias("table"),
        error.alias("error"),
    )


def contract_type_pattern(extra_types: tuple[str, ...] = ()) -> str:
    names = "|".join(CONTRACT_TYPES + tuple(extra_types))
    return rf"(?i)^({names})(\(\d+(,\s*\d+)?\))?\z"


def base_type(data_type: Column) -> Column:
    return F.substring_index(data_type, "(", 1)


def catalog_type(data_type: Column) -> Column:
    """Catalogue type for a contract type; unknown types fall back to VARCHAR."""
    pairs = [F.lit(text) for pair in CATALOG_TYPES.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), base_type(data_type)), F.lit("VARCHAR"))


def catalog_length(data_type: Column) -> Column:
    """Declared length of a text type, the default when none is given, null otherwise.

    Null, too, for a length no catalogue can hold; ``length_fits`` tells.
    """
    given = F.nullif(F.regexp_extract(data_type, r"\((\d+)", 1), F.lit(""))
    return F.when(
        catalog_type(data_type).isin("VARCHAR", "CHAR", "BINARY", "VARBINARY"),
        F.when(given.isNull(), F.lit(DEFAULT_TEXT_LENGTH)).otherwise(given.try_cast("int")),
    )


def length_fits(data_type: Column) -> Column:
    """The numbers in brackets are whole numbers of 32 bits."""
    numbers = F.regexp_extract_all(data_type, F.lit(r"(\d+)"), F.lit(1))
    return F.forall(numbers, lambda n: n.try_cast("int").isNotNull())
