"""Table grants: issue, expiry, reclaim, and the access decision per log row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.names import schema_table
from tarnwork.functions.times import as_timestamp, parse_time
from tarnwork.operators.keyed import lookup_join
from tarnwork.operators.ordered import MINUTE, running_max_at

NEVER = "9999-12-31 00:00:00"

# ---- fixed values: must equal the published access policy ------------------
SERVICE_ACCOUNTS = (
    "table_registration_service",
    "superset_service",
    "dbt_demo_service",
    "platform_sdk_demo_service",
)
ADMIN_GROUPS = ("platform-team",)
BROWSE_OPERATIONS = (
    "ExecuteQuery",
    "AccessCatalog",
    "ShowSchemas",
    "ShowTables",
    "ShowColumns",
    "ShowCreateSchema",
    "FilterCatalogs",
    "FilterSchemas",
    "FilterTables",
    "FilterColumns",
)
GATED_OPERATIONS = ("SelectFromColumns", "ShowCreateTable")
GRANT_DAYS = 180
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AccessPolicy:
    service_accounts: tuple[str, ...] = SERVICE_ACCOUNTS
    admin_groups: tuple[str, ...] = ADMIN_GROUPS
    browse_operations: tuple[str, ...] = BROWSE_OPERATIONS
    gated_operations: tuple[str, ...] = GATED_OPERATIONS


def expired_for_policy(expires_at: Column, now: Column) -> Column:
    """A given expiry lies before now.  Blank never expires, unreadable text does not count."""
    return F.coalesce(parse_time(F.trim(expires_at)) < now, F.lit(False))


def expired_for_reclaim(expires_at: Column, now: Column) -> Column:
    """As above, and an expiry at now itself is over as well."""
    return F.coalesce(parse_time(F.trim(expires_at)) <= now, F.lit(False))


def issue_grants(approved: DataFrame, now: Column, days: int = GRANT_DAYS, transition: dict[str, str] | None = None) -> DataFrame:
    """Grant rows for approved requests: granted now, expiring after ``days``.

    ``transition`` names columns of ``approved`` that go along (old to new
    name), so that ``append_once`` can tell which approval a grant came from.
    """
    return approved.select(
        *[F.col(old).alias(new) for old, new in (transition or {}).items()],
        "username",
        "table_fqn",
        "security_level",
        now.alias("granted_at"),
        (now + F.make_dt_interval(days=F.lit(days))).alias("expires_at"),
    )


def active_grants(grants: DataFrame, now) -> DataFrame:
    return grants.where(~expired_for_policy(F.col("expires_at"), as_timestamp(now)))


def expired_grants(grants: DataFrame, now) -> DataFrame:
    return grants.where(expired_for_reclaim(F.col("expires_at"), as_timestamp(now)))


def kept_grants(grants: DataFrame, now) -> DataFrame:
    return grants.where(~expired_for_reclaim(F.col("expires_at"), as_timestamp(now)))


def _live_until(expires_at: Column) -> Column:
    return F.coalesce(parse_time(F.trim(expires_at)), F.lit(NEVER).cast("timestamp"))


def with_grant(log: DataFrame, grants: DataFrame, *, respect_granted_at: bool = True, slice_seconds: int = MINUTE) -> DataFrame:
    """Log rows with ``granted``: a grant for (user, schema.table) is live at ``ts``.

    Only the latest expiry matters: a grant is live iff the greatest
    ``expires_at`` among the grants of the pair is not before ``ts``.  So no
    log row ever meets more than one row per pair, however many grants or log
    rows a pair has.  With ``respect_granted_at`` only grants issued up to
    ``ts`` count (a running maximum), else all of them do (an aggregate).
    """
    keyed_log = log.withColumn("__table", schema_table(F.col("table_fqn")))
    facts = grants.select(
        F.col("username").alias("user"),
        schema_table(F.col("table_fqn")).alias("__table"),
        parse_time(F.col("granted_at")).alias("__from"),
        _live_until(F.col("expires_at")).alias("__until"),
    )
    if respect_granted_at:
        joined = running_max_at(
            facts,
            keyed_log,
            ["user", "__table"],
            fact_time="__from",
            probe_time="ts",
            value=F.col("__until"),
            out="__best",
            slice_seconds=slice_seconds,
        )
    else:
        best = facts.groupBy("user", "__table").agg(F.max("__until").alias("__best"))
        joined = lookup_join(keyed_log, best, ["user", "__table"])
    return joined.select(*log.columns, F.coalesce(F.col("__best") >= F.col("ts"), F.lit(False)).alias("granted"))


def access_decisions(
    log: DataFrame,
    grants: DataFrame,
    policy: AccessPolicy = AccessPolicy(),
    *,
    respect_granted_at: bool = True,
    slice_seconds: int = MINUTE,
) -> DataFrame:
    """``allowed`` and the first matching ``reason`` for every log row.

    ``log`` has user, groups (array), operation, table_fqn and ts.  Rows which
    the local rules settle never reach the exchange.
    """
    in_admin_group = F.exists("groups", lambda g: g.isin(*policy.admin_groups))
    local = (
        F.when(F.col("user").isin(*policy.service_accounts), F.lit("service account"))
        .when(F.coalesce(in_admin_group, F.lit(False)), F.lit("admin group"))
        .when(F.col("operation").isin(*policy.browse_operations), F.lit("browse"))
    )
    # The verdict is folded into one total column: a null would match neither filter.
    settled = F.coalesce(
        local, F.when(F.col("operation").isin(*policy.gated_operations), F.lit("gated")).otherwise(F.lit("denied"))
    )
    marked = log.withColumn("reason", settled)
    gated = with_grant(
        marked.where(F.col("reason") == "gated").drop("reason"),
        grants,
        respect_granted_at=respect_granted_at,
        slice_seconds=slice_seconds,
    )
    by_grant = gated.select(
        *log.columns, F.when(F.col("granted"), F.lit("grant")).otherwise(F.lit("denied")).alias("reason")
    )
    return (
        marked.where(F.col("reason") != "gated")
        .unionByName(by_grant)
        .withColumn("allowed", F.col("reason") != "denied")
    )
