"""Group membership: drift against the declared state, hand-over, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.keyed import lookup_join, rows_in, rows_not_in

KEYS = ["username", "group"]


def to_add(
    desired: DataFrame,
    current: DataFrame,
    known_groups: DataFrame | None = None,
    known_users: DataFrame | None = None,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Declared pairs that do not exist yet, in known groups (and for known users) only.

    Other ``keys``, such as (group, role), are compared the same way.
    """
    wanted = desired if known_groups is None else rows_in(desired, known_groups, ["group"])
    wanted = wanted if known_users is None else rows_in(wanted, known_users, ["username"])
    return wanted.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")


def to_remove(
    desired: DataFrame, current: DataFrame, known_groups: DataFrame | None = None, keys: list[str] = KEYS
) -> DataFrame:
    """Existing pairs that are declared no more, in known groups only."""
    present = current if known_groups is None else rows_in(current, known_groups, ["group"])
    return present.select(*keys).distinct().join(desired.select(*keys), keys, "left_anti")


def unknown_users(desired: DataFrame, known_users: DataFrame) -> DataFrame:
    """Declared users without an account: their memberships wait."""
    return rows_not_in(desired.select("username").distinct(), known_users, ["username"])


def unknown_groups(memberships: DataFrame, known_groups: DataFrame) -> DataFrame:
    return rows_not_in(memberships.select("group").distinct(), known_groups, ["group"])


def members(memberships: DataFrame) -> DataFrame:
    """Distinct (group, username) with the size of the group.

    A group is a set of rows and is never gathered into one value: a group may
    have most of the users.
    """
    unique = memberships.select(*KEYS).distinct()
    sizes = unique.groupBy("group").agg(F.count(F.lit(1)).alias("member_count"))
    return lookup_join(unique, sizes, ["group"], "inner")


def transfer(memberships: DataFrame, handover: DataFrame) -> DataFrame:
    """Memberships after every to_user got the groups of its from_user in addition."""
    pairs = handover.where(F.col("from_user") != F.col("to_user"))
    gained = (
        memberships.join(pairs, F.col("username") == F.col("from_user"))
        .select(F.col("to_user").alias("username"), "group")
        .distinct()
        .join(memberships.select(*KEYS), KEYS, "left_anti")
    )
    return memberships.select(*KEYS).unionByName(gained)


def upsert(memberships: DataFrame, additions: DataFrame) -> DataFrame:
    """Append rows which are not there yet."""
    return memberships.select(*KEYS).unionByName(additions.select(*KEYS)).dropDuplicates(KEYS)
