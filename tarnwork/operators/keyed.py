"""Per-key reductions and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.session import cut_lineage, scratch_path


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of every key.

    An aggregate and no window: rows of a hot key are reduced in the map tasks
    already.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
    )


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], most: int, out: str = "position") -> DataFrame:
    """The first ``most`` rows of every key in an order, numbered from 1.

    The limit on the number is applied in the tasks before the exchange as
    well, so at most ``most`` rows of a key and task are moved.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= most)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join rows of any key distribution with a lookup of one row per key.

    A lookup that comes from an aggregate is already clustered by the key, and
    a join that reuses this clustering cannot be split by AQE.  The hash of the
    key as one more join column asks for a fresh exchange of the (reduced)
    lookup, so a hot key of ``rows`` is spread over many tasks.  A lookup that
    is small enough is broadcast by its size, as in any join.
    """
    fresh = F.xxhash64(*keys)
    return (
        rows.withColumn("__fresh", fresh).join(lookup.withColumn("__fresh", fresh), [*keys, "__fresh"], how).drop("__fresh")
    )


def rows_not_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right`` (set difference on keys)."""
    return lookup_join(left, right.select(*keys).distinct(), keys, "left_anti").select(*left.columns)


def rows_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return lookup_join(left, right.select(*keys).distinct(), keys, "left_semi").select(*left.columns)


def dense_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """(value, code): distinct values in sort order numbered 0..n-1.

    The distinct values are range-sorted over all tasks and numbered by
    partition; only the per-partition counts (one row per partition) go
    through a single task.  The codes are stored, so that their size is known
    to a join: few of them are broadcast, and no row is moved for them.
    """
    numbered = cut_lineage(
        df.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .orderBy(column)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id = partition number * 2**33 + row number.
    numbered = numbered.select(
        column,
        F.shiftright("__id", 33).alias("__part"),
        F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"),
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    codes = numbered.join(offsets, "__part").select(
        column, (F.col("__offset") + F.col("__pos")).cast("long").alias(out)
    )
    path = scratch_path(df.sparkSession, "codes")
    codes.write.parquet(path)
    return df.sparkSession.read.schema(codes.schema).parquet(path)


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, salts: int = 8) -> DataFrame:
    """Left join against one row per key, with every key spread over ``salts`` tasks.

    For places where AQE cannot split a hot key, such as streams.  The lookup
    side is repeated once per salt; each row of ``rows`` draws its salt from
    ``spread_by`` and so meets exactly one copy.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("__salt", salt).join(copies, [key, "__salt"], "left").drop("__salt")
