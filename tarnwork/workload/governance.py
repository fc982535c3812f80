"""Grants, access decisions, approvals, contracts, membership, catalogue, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.plans import access, approvals, catalog, contracts, membership
from tarnwork.session import scratch_path
from tarnwork.sinks.once import append_once, read_once
from tarnwork.workload import views as v
from tarnwork.workload.registry import SQL, VIEW_SQL, query

NOW = "2024-01-15 00:00:00"
SLA_NOW = "2000-01-01 12:00:00"
_GRANT = "username, table_fqn, security_level, granted_at, expires_at"

# -- grants and access -------------------------------------------------------


VIEW_SQL["v_final"] = """
SELECT request_id, CASE WHEN bool_or(status = 'rejected') THEN 'rejected'
    WHEN coalesce(bool_and(status = 'approved') FILTER (status NOT IN ('escalated', 'skipped')), false) THEN 'approved'
    ELSE 'pending' END AS status
FROM v_approval_steps GROUP BY request_id
"""


@query(
    "grant_issue",
    """SELECT username, table_fqn, security_level, requested_at AS granted_at, requested_at + INTERVAL 180 DAY AS expires_at
    FROM v_table_requests WHERE id IN (SELECT request_id FROM v_final WHERE status = 'approved')""",
)
def grant_issue(spark: SparkSession, sf: str) -> DataFrame:
    approved = approvals.approved_requests(v.table_requests(spark, sf), v.approval_steps(spark, sf))
    return access.issue_grants(approved, F.col("requested_at"))


@query(
    "grant_issue_once",
    """SELECT id AS request_id, decided_at, username, table_fqn, security_level, decided_at AS granted_at,
        decided_at + INTERVAL 180 DAY AS expires_at
    FROM v_table_requests JOIN (SELECT request_id, max(activated_at) AS decided_at FROM v_approval_steps GROUP BY ALL) ON request_id = id
    WHERE id IN (SELECT request_id FROM v_final WHERE status = 'approved')""",
)
def grant_issue_once(spark: SparkSession, sf: str) -> DataFrame:
    """The grant table after three runs over approvals that overlap, the last of them a repeat: every approval granted once."""
    root = scratch_path(spark, "grants")
    approved = approvals.approved_transitions(v.table_requests(spark, sf), v.approval_steps(spark, sf))
    grants = access.issue_grants(approved, F.col("decided_at"), transition={"id": "request_id", "decided_at": "decided_at"})
    for run, part in (("first half", grants.where("request_id % 2 = 0")), ("all", grants), ("all", grants)):
        append_once(part, root, run, ["request_id", "decided_at"], "decided_at")
    return read_once(spark, root, grants.schema)


@query(
    "request_clean",
    """SELECT doc_id AS id, left(trim(regexp_replace(source, '[^a-zA-Z0-9_.]', ' ', 'g')), 300) AS table_fqn,
        left(coalesce("text", ''), 500) AS reason,
        length(trim(regexp_replace(source, '[^a-zA-Z0-9_.]', ' ', 'g'))) > 300 OR length(coalesce("text", '')) > 500 AS shortened FROM documents
    WHERE trim(regexp_replace(source, '[^a-zA-Z0-9_.]', ' ', 'g')) <> ''""",
)
def request_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Forms with long texts: every document is a reason, its source the table."""
    submitted = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.regexp_replace("source", "[^a-zA-Z0-9_.]", " ").alias("table_fqn"),
        F.col("text").alias("reason"),
    )
    return approvals.clean_requests(submitted)


@query("grants_active", f"SELECT {_GRANT} FROM v_grants WHERE expires_ts IS NULL OR expires_ts >= TIMESTAMP '{NOW}'")
def grants_active(spark: SparkSession, sf: str) -> DataFrame:
    return access.active_grants(v.grants(spark, sf), NOW)


@query("grants_expired", f"SELECT {_GRANT} FROM v_grants WHERE expires_ts <= TIMESTAMP '{NOW}'")
def grants_expired(spark: SparkSession, sf: str) -> DataFrame:
    return access.expired_grants(v.grants(spark, sf), NOW)


@query("grants_kept", f"SELECT {_GRANT} FROM v_grants WHERE expires_ts IS NULL OR expires_ts > TIMESTAMP '{NOW}'")
def grants_kept(spark: SparkSession, sf: str) -> DataFrame:
    return access.kept_grants(v.grants(spark, sf), NOW)


_LIVE = """EXISTS (SELECT 1 FROM v_grants g WHERE g.username = l."user" AND g.table_fqn = l.short_name {from_then}
    AND (g.expires_ts IS NULL OR g.expires_ts >= l.ts))"""
_FROM_THEN = "AND g.granted_ts <= l.ts"
_DECISION = """
SELECT event_id, "user", operation, table_fqn, ts, reason, reason <> 'denied' AS allowed FROM (
    SELECT *, CASE WHEN "user" = 'superset_service' THEN 'service account' WHEN is_admin THEN 'admin group'
        WHEN operation = 'ShowTables' THEN 'browse' WHEN operation = 'InsertIntoTable' THEN 'denied'
        WHEN {live} THEN 'grant' ELSE 'denied' END AS reason
    FROM v_access_log l)
"""


@query("access_decision", _DECISION.format(live=_LIVE.format(from_then=_FROM_THEN)))
def access_decision(spark: SparkSession, sf: str) -> DataFrame:
    return access.access_decisions(v.access_log(spark, sf), v.grants(spark, sf)).drop("groups")


@query("access_decision_expiry_only", _DECISION.format(live=_LIVE.format(from_then="")))
def access_decision_expiry_only(spark: SparkSession, sf: str) -> DataFrame:
    decided = access.access_decisions(v.access_log(spark, sf), v.grants(spark, sf), respect_granted_at=False)
    return decided.drop("groups")


_LOG_COLUMNS = 'event_id, "user", operation, table_fqn, ts'


def _with_grant(spark: SparkSession, sf: str) -> DataFrame:
    return access.with_grant(v.access_log(spark, sf), v.grants(spark, sf)).drop("groups")


@query("access_allowed", f"SELECT {_LOG_COLUMNS} FROM v_access_log l WHERE {_LIVE.format(from_then=_FROM_THEN)}")
def access_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return _with_grant(spark, sf).where("granted").drop("granted")


@query("access_denied", f"SELECT {_LOG_COLUMNS} FROM v_access_log l WHERE NOT {_LIVE.format(from_then=_FROM_THEN)}")
def access_denied(spark: SparkSession, sf: str) -> DataFrame:
    return _with_grant(spark, sf).where(~F.col("granted")).drop("granted")


# -- organisation and approvals ----------------------------------------------

VIEW_SQL["v_managers"] = """
SELECT e.username, e.name, m.username AS manager_username
FROM v_employees e LEFT JOIN v_employees m ON m.employee_id = nullif(e.manager_id, '')
"""
VIEW_SQL["v_chain2"] = """
SELECT a.username, a.manager_username AS manager_1, b.manager_username AS manager_2
FROM v_managers a LEFT JOIN v_managers b ON b.username = a.manager_username
"""


@query("manager_resolve", "SELECT * FROM v_managers")
def manager_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.resolve_managers(v.employees(spark, sf))


@query("manager_chain2", "SELECT * FROM v_chain2")
def manager_chain2(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.manager_chain(v.employees(spark, sf), levels=2)


@query(
    "manager_chain4",
    """SELECT a.username, a.manager_1, a.manager_2, b.manager_1 AS manager_3, b.manager_2 AS manager_4
    FROM v_chain2 a LEFT JOIN v_chain2 b ON b.username = a.manager_2""",
)
def manager_chain4(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.manager_chain(v.employees(spark, sf), levels=4)


VIEW_SQL["v_listed"] = """
SELECT r.id AS request_id, t.* FROM v_table_requests r LEFT JOIN v_chain2 c USING (username),
    LATERAL (VALUES (1, 1, 'manager', c.manager_1), (1, 2, 'table_owner', nullif(r.table_owner, '')),
        (2, 3, 'manager_manager', CASE WHEN r.security_level >= 2 THEN c.manager_2 END),
        (3, 4, 'designated_admin', CASE WHEN r.security_level >= 3 THEN 'admin' END))
    AS t(step_order, place, approver_role, approver_username)
WHERE t.approver_username IS NOT NULL AND r.security_level IS NOT NULL
"""


@query(
    "approval_chain",
    """SELECT request_id, CAST(step_order AS INTEGER) AS step_order, approver_role, approver_username FROM v_listed
    QUALIFY row_number() OVER (PARTITION BY request_id, approver_username ORDER BY place) = 1""",
)
def approval_chain(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.approval_chain(v.table_requests(spark, sf), v.employees(spark, sf))


@query(
    "request_admission",
    """SELECT id, username, table_fqn, coalesce(security_level, 0) AS security_level, table_owner,
        CASE WHEN security_level IS NULL OR n IS NULL THEN 'rejected' ELSE 'pending' END AS status,
        CASE WHEN security_level IS NULL THEN 'security level unknown' WHEN n IS NULL THEN 'no approver' END AS note
    FROM v_table_requests LEFT JOIN (SELECT request_id AS id, count(*) AS n FROM v_listed GROUP BY 1) USING (id)""",
)
def request_admission(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.admit_requests(v.table_requests(spark, sf), v.employees(spark, sf))


@query("approval_steps", "SELECT * FROM v_approval_steps")
def approval_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The derivation of the step table itself, not the stored copy."""
    return v.derived_steps(spark, sf)


_OPEN = "status IN ('pending', 'pending_external')"


@query(
    "current_step",
    f"SELECT request_id, min(step_order) FILTER ({_OPEN}) AS current_step FROM v_approval_steps GROUP BY request_id",
)
def current_step(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.current_steps(v.approval_steps(spark, sf))


_WORK_LIST = """
SELECT s.request_id, s.id AS step_id, step_order, approver_username, username, table_fqn, security_level
FROM v_approval_steps s JOIN v_table_requests r ON r.id = s.request_id
WHERE s.status = 'pending' AND step_order = (SELECT min(step_order) FROM v_approval_steps o
    WHERE o.request_id = s.request_id AND o.{open})
"""


@query("approver_worklist", _WORK_LIST.format(open=_OPEN))
def approver_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.work_list(v.approval_steps(spark, sf), v.table_requests(spark, sf))


@query("approver_worklist_local", _WORK_LIST.format(open="status = 'pending'"))
def approver_worklist_local(spark: SparkSession, sf: str) -> DataFrame:
    """The narrower meaning of "current": steps waiting elsewhere do not hold up later ones."""
    return approvals.work_list(v.approval_steps(spark, sf), v.table_requests(spark, sf), statuses=("pending",))


@query("request_final_status", "SELECT * FROM v_final")
def request_final_status(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.final_status(v.approval_steps(spark, sf))


@query(
    "steps_after_reject",
    f"""SELECT id, request_id, step_order, approver_username, CASE WHEN {_OPEN}
        AND bool_or(status = 'rejected') OVER (PARTITION BY request_id) THEN 'skipped' ELSE status END AS status, activated_at
    FROM v_approval_steps""",
)
def steps_after_reject(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.skip_after_reject(v.approval_steps(spark, sf))


@query(
    "steps_activated",
    f"""SELECT id, request_id, step_order, approver_username, status,
        CASE WHEN activated_at IS NULL AND status = 'pending' AND step_order = min(CASE WHEN {_OPEN} THEN step_order END)
            OVER (PARTITION BY request_id) THEN TIMESTAMP '{SLA_NOW}' ELSE activated_at END AS activated_at
    FROM (SELECT * REPLACE (CASE WHEN step_order > 1 THEN NULL ELSE activated_at END AS activated_at) FROM v_approval_steps)""",
)
def steps_activated(spark: SparkSession, sf: str) -> DataFrame:
    steps = v.approval_steps(spark, sf)
    waiting = steps.withColumn("activated_at", F.when(F.col("step_order") <= 1, F.col("activated_at")))
    return approvals.activate_steps(waiting, SLA_NOW)


VIEW_SQL["v_judged"] = f"""
SELECT s.id AS step_id, s.request_id, d.username, d.decision, CASE
    WHEN status <> 'pending' OR d.username <> approver_username THEN 'forbidden'
    WHEN d.decision = 'approved' AND step_order <> min(CASE WHEN {_OPEN} THEN step_order END) OVER (PARTITION BY request_id)
    THEN 'not its turn' ELSE 'applied' END AS outcome
FROM v_approval_steps s JOIN (SELECT id, CASE WHEN step_order = 2 THEN 'somebody' ELSE approver_username END AS username,
    CASE WHEN step_order = 3 THEN 'rejected' ELSE 'approved' END AS decision FROM v_approval_steps) d USING (id)
"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A decision on every step; those on second steps come from somebody else."""
    step = F.col("step_order")
    return v.approval_steps(spark, sf).select(
        F.col("id").alias("step_id"),
        F.when(step == 2, F.lit("somebody")).otherwise(F.col("approver_username")).alias("username"),
        F.when(step == 3, F.lit("rejected")).otherwise(F.lit("approved")).alias("decision"),
    )


@query("step_decisions", "SELECT step_id, username, decision, outcome FROM v_judged")
def step_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.judge_decisions(v.approval_steps(spark, sf), _decisions(spark, sf))


@query(
    "steps_decided",
    f"""SELECT id, request_id, step_order, approver_username, CASE WHEN {_OPEN}
        AND bool_or(status = 'rejected') OVER (PARTITION BY request_id) THEN 'skipped' ELSE status END AS status, activated_at
    FROM (SELECT s.* REPLACE (CASE WHEN outcome = 'applied' THEN decision ELSE status END AS status)
          FROM v_approval_steps s JOIN v_judged j ON j.step_id = s.id)""",
)
def steps_decided(spark: SparkSession, sf: str) -> DataFrame:
    steps = v.approval_steps(spark, sf)
    return approvals.apply_decisions(steps, approvals.judge_decisions(steps, _decisions(spark, sf)), SLA_NOW)


VIEW_SQL["v_sla"] = f"""
SELECT s.id AS step_id, request_id, step_order, approver_username, hours AS waited_hours,
    CASE WHEN hours >= 96 THEN 'escalate' ELSE 'remind' END AS action,
    CASE WHEN hours >= 96 THEN coalesce(manager_username, 'admin') END AS escalate_to
FROM (SELECT *, CAST(epoch_us(TIMESTAMP '{SLA_NOW}') - epoch_us(activated_at) AS DOUBLE) / 3600000000 AS hours
      FROM v_approval_steps WHERE {_OPEN}) s LEFT JOIN v_managers m ON m.username = s.approver_username
WHERE hours >= 48
"""


def _sla(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.sla_actions(v.approval_steps(spark, sf), v.employees(spark, sf), SLA_NOW)


@query("sla_actions", "SELECT * FROM v_sla")
def sla_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _sla(spark, sf)


@query(
    "sla_counts",
    "SELECT count(*) FILTER (action = 'remind') AS reminded, count(*) FILTER (action = 'escalate') AS escalated FROM v_sla",
)
def sla_counts(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.sla_counts(_sla(spark, sf))


@query(
    "sla_new_steps",
    f"""SELECT DISTINCT request_id, step_order, 'escalated' AS approver_role, escalate_to AS approver_username,
        'pending' AS status, TIMESTAMP '{SLA_NOW}' AS activated_at
    FROM v_sla a WHERE action = 'escalate' AND NOT EXISTS (SELECT 1 FROM v_approval_steps s
        WHERE s.request_id = a.request_id AND s.step_order = a.step_order AND s.approver_username = a.escalate_to)""",
)
def sla_new_steps(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.escalation_rows(_sla(spark, sf), v.approval_steps(spark, sf), SLA_NOW)


@query(
    "steps_after_escalation",
    f"""SELECT id, request_id, step_order, approver_username,
        CASE WHEN id IN (SELECT step_id FROM v_sla WHERE action = 'escalate') THEN 'escalated' ELSE status END AS status, activated_at
    FROM v_approval_steps
    UNION ALL SELECT DISTINCT request_id || '/' || step_order || '/' || escalate_to, request_id, step_order, escalate_to,
        'pending', TIMESTAMP '{SLA_NOW}'
    FROM v_sla a WHERE action = 'escalate' AND NOT EXISTS (SELECT 1 FROM v_approval_steps s
        WHERE s.request_id = a.request_id AND s.step_order = a.step_order AND s.approver_username = a.escalate_to)""",
)
def steps_after_escalation(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.escalate(v.approval_steps(spark, sf), v.employees(spark, sf), SLA_NOW)


@query(
    "requests_finalised",
    f"""SELECT id, username, table_fqn, coalesce(security_level, 0) AS security_level, table_owner,
        CASE WHEN security_level IS NULL OR n IS NULL THEN 'rejected' ELSE coalesce(f.status, 'pending') END AS status,
        CASE WHEN security_level IS NULL THEN 'security level unknown' WHEN n IS NULL THEN 'no approver' END AS note,
        CASE WHEN security_level IS NOT NULL AND n IS NOT NULL AND f.status <> 'pending' THEN TIMESTAMP '{SLA_NOW}' END AS decided_at
    FROM v_table_requests LEFT JOIN (SELECT request_id AS id, count(*) AS n FROM v_listed GROUP BY 1) USING (id)
    LEFT JOIN (SELECT request_id AS id, status FROM v_final) f USING (id)""",
)
def requests_finalised(spark: SparkSession, sf: str) -> DataFrame:
    """New requests after all decisions on their steps."""
    admitted = approvals.admit_requests(v.table_requests(spark, sf), v.employees(spark, sf))
    return approvals.finalise(admitted, v.approval_steps(spark, sf), SLA_NOW)


_STEP_LIST = """
SELECT r.id AS request_id, username, table_fqn, security_level, table_owner, requested_at,
    s.id AS step_id, s.step_order, s.approver_username, s.status AS step_status,
    min(CASE WHEN {open} THEN step_order END) OVER (PARTITION BY r.id) AS current_step
FROM {requests} r LEFT JOIN v_approval_steps s ON s.request_id = r.id
"""


@query("request_with_steps", _STEP_LIST.format(open=_OPEN, requests="v_table_requests"))
def request_with_steps(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.requests_with_steps(v.table_requests(spark, sf), v.approval_steps(spark, sf))


VIEW_SQL["v_group_decided"] = """
SELECT r.id, username, group_name, CASE WHEN r.status <> 'pending' OR verdict IS NULL THEN r.status WHEN verdict = 'reject' THEN 'rejected'
        WHEN group_name IN (SELECT "group" FROM v_known_groups) THEN 'applied' ELSE 'approved_pending_apply' END AS status, requested_at,
    CASE WHEN r.status = 'pending' THEN d.decided_by ELSE r.decided_by END AS decided_by,
    CASE WHEN r.status = 'pending' THEN d.decided_at ELSE r.decided_at END AS decided_at
FROM v_group_requests r LEFT JOIN (
    SELECT * FROM v_group_decisions QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY decided_at) = 1) d ON d.request_id = r.id
"""


def _decided_groups(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.decide_group_requests(
        v.group_requests(spark, sf), v.group_decisions(spark, sf), v.known_groups(spark, sf)
    )


@query(
    "audit_last_200",
    f"""SELECT 'table' AS kind, t.*, NULL AS group_name, NULL AS status, NULL AS decided_by, CAST(NULL AS TIMESTAMP) AS decided_at
    FROM ({_STEP_LIST.format(open=_OPEN, requests="(SELECT * FROM v_table_requests ORDER BY id DESC LIMIT 200)")}) t
    UNION ALL SELECT 'group', id, username, NULL, NULL, NULL, requested_at, NULL, NULL, NULL, NULL, NULL, group_name, status, decided_by, decided_at
    FROM (SELECT * FROM v_group_decided ORDER BY id DESC LIMIT 200)""",
)
def audit_last_200(spark: SparkSession, sf: str) -> DataFrame:
    """The newest requests of both kinds."""
    return approvals.full_audit_page(
        v.table_requests(spark, sf), v.approval_steps(spark, sf), _decided_groups(spark, sf)
    )


@query("group_requests_decided", "SELECT * FROM v_group_decided")
def group_requests_decided(spark: SparkSession, sf: str) -> DataFrame:
    return _decided_groups(spark, sf)


@query("group_requests_pending", "SELECT * FROM v_group_decided WHERE status = 'pending'")
def group_requests_pending(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.pending_group_requests(_decided_groups(spark, sf))


@query(
    "group_memberships_granted",
    """SELECT username, "group" FROM v_members_current
    UNION SELECT username, group_name FROM v_group_decided WHERE status = 'applied'""",
)
def group_memberships_granted(spark: SparkSession, sf: str) -> DataFrame:
    """The membership table after the applied group requests."""
    return membership.upsert(v.members_current(spark, sf), approvals.granted_memberships(_decided_groups(spark, sf)))


@query(
    "my_requests",
    _STEP_LIST.replace("requested_at,", "requested_at, position,").format(
        open=_OPEN,
        requests="""(SELECT *, row_number() OVER (PARTITION BY username ORDER BY id DESC) AS position FROM v_table_requests
            QUALIFY position <= 5)""",
    ),
)
def my_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The five newest requests of every user with their steps and the current step."""
    return approvals.own_requests(v.table_requests(spark, sf), v.approval_steps(spark, sf), most=5)


VIEW_SQL["v_moved"] = f"""
SELECT s.*, CASE WHEN {_OPEN} THEN coalesce(to_user, approver_username) ELSE approver_username END AS target
FROM v_approval_steps s LEFT JOIN v_handover h ON h.from_user = s.approver_username
"""


@query(
    "steps_transfer",
    """SELECT id, request_id, step_order, CASE WHEN transfer = 'transferred' THEN target ELSE approver_username END AS approver_username,
        status, activated_at, transfer
    FROM (SELECT *, CASE WHEN target = approver_username THEN NULL
        WHEN (request_id, step_order, target) IN (SELECT (request_id, step_order, approver_username) FROM v_approval_steps)
        OR count(*) FILTER (target <> approver_username) OVER (PARTITION BY request_id, step_order, target) > 1
        THEN 'conflict' ELSE 'transferred' END AS transfer
        FROM v_moved)""",
)
def steps_transfer(spark: SparkSession, sf: str) -> DataFrame:
    return approvals.transfer_steps(v.approval_steps(spark, sf), v.handover(spark, sf))


# -- membership --------------------------------------------------------------


def _members(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return v.members_desired(spark, sf), v.members_current(spark, sf), v.known_groups(spark, sf)


_KNOWN = '"group" IN (SELECT "group" FROM v_known_groups)'


@query(
    "membership_to_add",
    f"""SELECT DISTINCT username, "group" FROM v_members_desired WHERE {_KNOWN}
    EXCEPT SELECT username, "group" FROM v_members_current""",
)
def membership_to_add(spark: SparkSession, sf: str) -> DataFrame:
    return membership.to_add(*_members(spark, sf))


@query(
    "membership_to_remove",
    f"""SELECT DISTINCT username, "group" FROM v_members_current WHERE {_KNOWN}
    EXCEPT SELECT username, "group" FROM v_members_desired""",
)
def membership_to_remove(spark: SparkSession, sf: str) -> DataFrame:
    return membership.to_remove(*_members(spark, sf))


@query("unknown_groups", f'SELECT DISTINCT "group" FROM v_members_desired WHERE NOT {_KNOWN}')
def unknown_groups(spark: SparkSession, sf: str) -> DataFrame:
    return membership.unknown_groups(v.members_desired(spark, sf), v.known_groups(spark, sf))


@query(
    "group_members",
    """SELECT "group", username, count(*) OVER (PARTITION BY "group") AS member_count
    FROM (SELECT DISTINCT * FROM v_members_desired)""",
)
def group_members(spark: SparkSession, sf: str) -> DataFrame:
    return membership.members(v.members_desired(spark, sf))


@query(
    "membership_transfer",
    """SELECT username, "group" FROM v_members_desired UNION ALL (
        SELECT DISTINCT to_user, "group" FROM v_members_desired JOIN v_handover ON from_user = username
        EXCEPT SELECT username, "group" FROM v_members_desired)""",
)
def membership_transfer(spark: SparkSession, sf: str) -> DataFrame:
    return membership.transfer(v.members_desired(spark, sf), v.handover(spark, sf))


@query(
    "membership_unknown_users",
    """SELECT DISTINCT username FROM v_members_desired
    EXCEPT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0""",
)
def membership_unknown_users(spark: SparkSession, sf: str) -> DataFrame:
    accounts = v.table(spark, sf, "customer").where(F.col("c_acctbal") >= 0)
    known = accounts.select(F.col("c_custkey").cast("string").alias("username"))
    return membership.unknown_users(v.members_desired(spark, sf), known)


@query("membership_upsert", "SELECT * FROM v_members_current UNION SELECT * FROM v_members_desired")
def membership_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return membership.upsert(v.members_current(spark, sf), v.members_desired(spark, sf))


# -- contracts ---------------------------------------------------------------

VIEW_SQL["v_contract_lines"] = r"""
SELECT id, line_no, CASE WHEN strpos(body, ' ') > 0 THEN split_part(body, ' ', 1) END AS name,
    CASE WHEN strpos(body, ' ') > 0 THEN upper(trim(substr(body, strpos(body, ' ')))) END AS type
FROM (SELECT id, trim(line) AS body, line_no FROM (
    SELECT id, unnest(string_split(trim(columns_raw, E' \n'), E'\n')) AS line,
        generate_subscripts(string_split(trim(columns_raw, E' \n'), E'\n'), 1) AS line_no
    FROM v_contracts)) WHERE body <> ''
"""
VIEW_SQL["v_contract_checked"] = r"""
SELECT *, CASE WHEN name IS NULL THEN 'expected name and type'
    WHEN NOT regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*') THEN 'invalid column name'
    WHEN NOT regexp_full_match(type, '(VARCHAR|CHAR|BIGINT|INTEGER|INT|SMALLINT|TINYINT|DOUBLE|REAL|BOOLEAN|DATE|TIMESTAMP|DECIMAL)(\(\d+(,\s*\d+)?\))?')
    THEN 'unsupported type' END AS error
FROM v_contract_lines
"""
VIEW_SQL["v_contract_errors"] = """
SELECT id, CAST(min(line_no) FILTER (error IS NOT NULL) AS INTEGER) AS line_no,
    CASE WHEN count(name) + count(error) = 0 THEN 'at least one column is required'
         ELSE min_by(error, line_no) FILTER (error IS NOT NULL) END AS reason
FROM v_contracts LEFT JOIN v_contract_checked USING (id) GROUP BY id
"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.check_contracts(v.contracts(spark, sf), "columns_raw")


_ACCEPTED = """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY c.line_no) AS INTEGER) AS position, name, type
FROM v_contract_checked c JOIN v_contract_errors e USING (id) WHERE e.reason IS NULL
"""


@query("contract_columns", _ACCEPTED)
def contract_columns(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.accepted_columns(_checked(spark, sf), ["id"])


@query("contract_errors", "SELECT * FROM v_contract_errors WHERE reason IS NOT NULL")
def contract_errors(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.rejected_contracts(_checked(spark, sf), ["id"])


@query(
    "contract_type_map",
    f"""SELECT id, position, name, type, base_type,
        CASE base_type WHEN 'INTEGER' THEN 'INT' WHEN 'REAL' THEN 'FLOAT' WHEN 'DECIMAL' THEN 'VARCHAR' ELSE base_type END AS catalog_type,
        CASE WHEN base_type IN ('VARCHAR', 'CHAR', 'DECIMAL')
            THEN coalesce(TRY_CAST(regexp_extract(type, '\\((\\d+)', 1) AS INTEGER), 255) END AS data_length
    FROM (SELECT *, split_part(type, '(', 1) AS base_type FROM ({_ACCEPTED}))""",
)
def contract_type_map(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.catalog_columns(contracts.accepted_columns(_checked(spark, sf), ["id"]))


@query(
    "registration_audit",
    f"""SELECT id, 'u' || (id % 9) AS requested_by, 'iceberg.demo.t' || id AS table_fqn, 'owner' AS owner,
        1 AS security_level, columns_raw, CASE WHEN reason IS NULL THEN 'created' ELSE 'rejected' END AS table_status,
        CASE WHEN reason IS NULL THEN 'registered' ELSE 'skipped' END AS catalog_status, reason AS note,
        TIMESTAMP '{NOW}' AS created_at
    FROM v_contracts JOIN v_contract_errors USING (id)""",
)
def registration_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _registrations(spark, sf)


def _registrations(spark: SparkSession, sf: str) -> DataFrame:
    requests = v.contracts(spark, sf).select(
        "id",
        F.concat(F.lit("u"), (F.col("id") % 9).cast("string")).alias("requested_by"),
        F.concat(F.lit("demo.t"), F.col("id").cast("string")).alias("table_fqn"),
        F.lit("owner").alias("owner"),
        F.lit(1).alias("security_level"),
        "columns_raw",
    )
    return contracts.registration_rows(requests, F.lit(NOW).cast("timestamp"))


@query("registration_append", SQL["registration_audit"])
def registration_append(spark: SparkSession, sf: str) -> DataFrame:
    """The audit table after three runs: one for some registrations, one for all of them, and that one once more."""
    root, rows = scratch_path(spark, "registrations"), _registrations(spark, sf)
    for run, part in (("morning", rows.where("id % 3 = 0")), ("evening", rows), ("evening", rows)):
        append_once(part, root, run, ["id", "created_at"], "created_at")
    return read_once(spark, root, rows.schema)


@query(
    "my_registrations",
    f"""SELECT *, row_number() OVER (PARTITION BY requested_by ORDER BY id DESC) AS position FROM ({SQL["registration_audit"]})
    QUALIFY position <= 20""",
)
def my_registrations(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty newest registrations of every user."""
    return approvals.own_registrations(_registrations(spark, sf), most=20)


# -- catalogue and lineage ---------------------------------------------------


@query("governance_lookup", 'SELECT fqn, "schema", security_level, owner, column_names FROM v_entities')
def governance_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = catalog.entity_rows(v.catalog_documents(spark, sf))
    return found.withColumn("column_names", F.concat_ws(",", "columns")).drop("columns")


@query(
    "catalog_search",
    """SELECT fqn, "schema", security_level, owner, column_names FROM v_entities
    WHERE lower(fqn) LIKE '%.t1%' AND "schema" = 's3' AND security_level = 3 ORDER BY fqn LIMIT 200""",
)
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    entities = catalog.entity_rows(v.catalog_documents(spark, sf))
    page = catalog.search(entities, keyword=".t1", schema="s3", level=3)
    return page.withColumn("column_names", F.concat_ws(",", "columns")).drop("columns")


@query(
    "catalog_diff",
    """SELECT table_name, CASE WHEN b.signature IS NULL THEN 'new' WHEN a.signature IS NULL THEN 'deleted' ELSE 'changed' END AS change
    FROM v_scan_before b FULL JOIN v_scan_after a USING (table_name)
    WHERE b.signature IS DISTINCT FROM a.signature""",
)
def catalog_diff(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.scan_difference(v.scan_before(spark, sf), v.scan_after(spark, sf))


@query("lineage_edges", "SELECT pipeline_id, table_fqn, table_id FROM v_sinks JOIN v_known_tables USING (table_fqn)")
def lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lineage_edges(catalog.sink_tables(v.job_runs(spark, sf)), v.known_tables(spark, sf))


@query("lineage_unresolved", "SELECT * FROM v_sinks WHERE table_fqn NOT IN (SELECT table_fqn FROM v_known_tables)")
def lineage_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unresolved_sinks(catalog.sink_tables(v.job_runs(spark, sf)), v.known_tables(spark, sf))
