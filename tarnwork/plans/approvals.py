"""Approval chains on table-access requests: who approves, what is open, what is late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.names import strip
from tarnwork.functions.once import let
from tarnwork.functions.times import as_timestamp, hours_between
from tarnwork.operators.keyed import first_of_each, lookup_join, rows_in
from tarnwork.session import cut_lineage

OPEN = ("pending", "pending_external")
IGNORED = ("escalated", "skipped")

# ---- fixed values: notes and thresholds of the approval flow ---------------
REMIND_HOURS = 48.0
ESCALATE_FACTOR = 2.0
DESIGNATED_ADMIN = "admin"
NO_LEVEL = "security level unknown"
NO_APPROVER = "no approver"
NAME_LENGTH, REASON_LENGTH = 300, 500
# ---------------------------------------------------------------------------


def _present(name: Column) -> Column:
    """A name that can stand for a person; chain and admission share it."""
    return name.isNotNull() & (name != "")


def resolve_managers(employees: DataFrame) -> DataFrame:
    """(username, name, manager_username), one row per username.

    A blank or unknown manager id, and a manager without a name, give null.  Of
    several rows with one id the least username counts, of several with one
    username the row with the least id, so nobody multiplies requests.
    """
    ids = (
        employees.where(_present(F.col("username")))
        .groupBy(F.col("employee_id").alias("__id"))
        .agg(F.min("username").alias("manager_username"))
    )
    staff = employees.groupBy("username").agg(
        F.min_by(F.struct("name", "manager_id"), F.struct("employee_id", "name", "manager_id")).alias("__row")
    )
    wanted = F.nullif(F.trim("__row.manager_id"), F.lit(""))
    return lookup_join(
        staff.select("username", F.col("__row.name").alias("name"), wanted.alias("__id")), ids, ["__id"]
    ).select("username", "name", "manager_username")


def manager_chain(employees: DataFrame, levels: int = 2, checkpoint_every: int = 4) -> DataFrame:
    """(username, manager_1 .. manager_n); null from the first missing manager on.

    One equi-join per level; deep chains cut the plan every few levels.
    """
    direct = resolve_managers(employees).select("username", "manager_username")
    chain = direct.select("username", F.col("manager_username").alias("manager_1"))
    for level in range(2, levels + 1):
        step = direct.select(
            F.col("username").alias(f"manager_{level - 1}"), F.col("manager_username").alias(f"manager_{level}")
        )
        chain = chain.join(step, f"manager_{level - 1}", "left")
        if level % checkpoint_every == 0 and level < levels:
            chain = cut_lineage(chain)
    return chain.select("username", *[f"manager_{i}" for i in range(1, levels + 1)])


def approval_chain(requests: DataFrame, employees: DataFrame, designated_admin: str = DESIGNATED_ADMIN) -> DataFrame:
    """One row per required approver: (request_id, step_order, approver_role, approver_username).

    Step numbers are the level numbers.  A person approves once, at the first
    place of the list.  The candidates of a request are an array of at most
    four, deduplicated inside the row: no exchange beyond the manager lookup.
    """
    managers = manager_chain(employees, levels=2)
    routed = requests.where(F.col("security_level").isNotNull()).join(managers, "username", "left")
    level = F.col("security_level")

    def candidate(step: int, role: str, user: Column, applies: Column) -> Column:
        return F.when(
            applies & _present(user),
            F.struct(F.lit(step).alias("step_order"), F.lit(role).alias("approver_role"), user.alias("approver_username")),
        )

    always = F.lit(True)
    listed = F.array_compact(
        F.array(
            candidate(1, "manager", F.col("manager_1"), always),
            candidate(1, "table_owner", F.col("table_owner"), always),
            candidate(2, "manager_manager", F.col("manager_2"), level >= 2),
            candidate(3, "designated_admin", F.lit(designated_admin), level >= 3),
        )
    )
    def first_places(steps: Column) -> Column:
        users = F.transform(steps, lambda s: s["approver_username"])
        return F.filter(steps, lambda s, i: F.array_position(users, s["approver_username"]) == i + 1)

    return routed.select(F.col("id").alias("request_id"), F.inline(let(listed, first_places)))


def clean_requests(
    submitted: DataFrame, name_length: int | None = NAME_LENGTH, reason_length: int | None = REASON_LENGTH
) -> DataFrame:
    """Submitted forms as requests: trimmed names, no row without a table name.

    Names and reasons are shortened to the form's lengths, and ``shortened``
    marks the rows where that took something away; None leaves them whole.
    """
    name, reason = strip(F.col("table_fqn")), F.coalesce("reason", F.lit(""))
    texts = {"table_fqn": (name, name_length), "reason": (reason, reason_length)}
    cut = [F.length(text) > F.lit(most) for text, most in texts.values() if most is not None]
    mark = F.coalesce(F.greatest(*cut, F.lit(False)), F.lit(False)) if cut else F.lit(False)
    return submitted.select(
        *(c for c in submitted.columns if c not in (*texts, "shortened")),
        *((text if most is None else F.left(text, F.lit(most))).alias(c) for c, (text, most) in texts.items()),
        mark.alias("shortened"),
    ).where(F.col("table_fqn") != "")


def admit_requests(requests: DataFrame, employees: DataFrame, designated_admin: str = DESIGNATED_ADMIN) -> DataFrame:
    """Status of new requests: rejected without a level or without any approver, else pending.

    Whether anybody approves follows from the same columns the chain is made
    of, so the chain itself is not built or counted here.
    """
    managers = manager_chain(employees, levels=1)
    routed = requests.join(managers, "username", "left")
    has_approver = _present(F.col("manager_1")) | _present(F.col("table_owner")) | (
        (F.col("security_level") >= 3) & F.lit(bool(designated_admin))
    )
    note = F.when(F.col("security_level").isNull(), F.lit(NO_LEVEL)).when(~has_approver, F.lit(NO_APPROVER))
    return routed.select(
        "id",
        "username",
        "table_fqn",
        F.coalesce("security_level", F.lit(0)).alias("security_level"),
        "table_owner",
        F.when(note.isNull(), F.lit("pending")).otherwise(F.lit("rejected")).alias("status"),
        note.alias("note"),
    )


def _is_open(statuses: tuple[str, ...] = OPEN) -> Column:
    return F.coalesce(F.col("status").isin(*statuses), F.lit(False))


def current_steps(steps: DataFrame, statuses: tuple[str, ...] = OPEN) -> DataFrame:
    """(request_id, current_step): lowest step that still has an open row, null when none."""
    return steps.groupBy("request_id").agg(
        F.min(F.when(F.col("status").isin(*statuses), F.col("step_order"))).alias("current_step")
    )


def _open_minimum(steps: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """The same without the requests that have no open row."""
    return steps.where(_is_open(statuses)).groupBy("request_id").agg(F.min("step_order").alias("current_step"))


def work_list(steps: DataFrame, requests: DataFrame, approver: str | None = None, statuses: tuple[str, ...] = OPEN) -> DataFrame:
    """Pending steps whose turn it is, with their request, for one or for all approvers."""
    due = steps.where(F.col("status") == "pending")
    if approver is not None:
        due = due.where(F.col("approver_username") == approver)
    asked = requests.select(F.col("id").alias("request_id"), "username", "table_fqn", "security_level")
    # Both have one row per request: joined first, so that the steps move once.
    turn = _open_minimum(steps, statuses).join(asked, "request_id")
    return (
        lookup_join(due, turn, ["request_id"], "inner")
        .where(F.col("step_order") == F.col("current_step"))
        .select("request_id", F.col("id").alias("step_id"), "step_order", "approver_username", "username", "table_fqn", "security_level")
    )


def final_status(steps: DataFrame) -> DataFrame:
    """(request_id, status): any rejection rejects, all decided rows approved approves."""
    status = F.col("status")
    counts = ~status.isin(*IGNORED)
    return steps.groupBy("request_id").agg(
        F.bool_or(status == "rejected").alias("__rejected"),
        F.coalesce(F.bool_and(F.when(counts, status == "approved")), F.lit(False)).alias("__approved"),
    ).select(
        "request_id",
        F.when(F.col("__rejected"), F.lit("rejected"))
        .when(F.col("__approved"), F.lit("approved"))
        .otherwise(F.lit("pending"))
        .alias("status"),
    )


def judge_decisions(steps: DataFrame, decisions: DataFrame, external: bool = False) -> DataFrame:
    """Outcome of decisions: "applied", "forbidden" or "not its turn".

    ``decisions``: step_id, username, decision (approved or rejected), one row
    per step.  A person decides a pending step of their own, and approves it
    only when it is the current one; rejecting is possible ahead of the turn.
    With ``external`` the decisions come from the system that holds the
    step, so neither person nor turn is asked.
    """
    state = steps.select(
        F.col("id").alias("step_id"), "request_id", "step_order", F.col("status").alias("__status"), "approver_username"
    )
    known = decisions.join(state, "step_id", "left")
    if external:
        allowed = F.col("__status") == "pending_external"
    else:
        allowed = (F.col("__status") == "pending") & (F.col("approver_username") == F.col("username"))
    judged = lookup_join(known, _open_minimum(steps, OPEN), ["request_id"])
    early = (F.col("decision") == "approved") & (F.col("step_order") != F.col("current_step"))
    outcome = F.when(~F.coalesce(allowed, F.lit(False)), F.lit("forbidden"))
    if not external:
        outcome = outcome.when(early, F.lit("not its turn"))
    return judged.select(*decisions.columns, outcome.otherwise(F.lit("applied")).alias("outcome"))


def apply_decisions(steps: DataFrame, judged: DataFrame, now) -> DataFrame:
    """Steps after the applied decisions; open rows of rejected requests are skipped."""
    applied = judged.where(F.col("outcome") == "applied").select(F.col("step_id").alias("id"), "decision")
    decided = steps.join(applied, "id", "left").withColumn("status", F.coalesce("decision", "status"))
    if "decided_at" in steps.columns:
        decided = decided.withColumn(
            "decided_at", F.when(F.col("decision").isNotNull(), as_timestamp(now)).otherwise(F.col("decided_at"))
        )
    return skip_after_reject(decided.select(*steps.columns))


def approved_requests(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Requests whose steps are all approved: the input of grant issue."""
    approved = final_status(steps).where(F.col("status") == "approved").select(F.col("request_id").alias("id"))
    return requests.join(approved, "id", "left_semi")


def skip_after_reject(steps: DataFrame) -> DataFrame:
    """Steps with the open rows of rejected requests set to skipped.

    Only open rows can change, so only they are looked up; the others pass.
    """
    open_row = _is_open()
    rejected = steps.where(F.col("status") == "rejected").select("request_id").distinct()
    looked_up = lookup_join(steps.where(open_row), rejected.withColumn("__rejected", F.lit(True)), ["request_id"])
    status = F.when(F.col("__rejected"), F.lit("skipped")).otherwise(F.col("status"))
    return steps.where(~open_row).unionByName(looked_up.withColumn("status", status).select(*steps.columns))


def activate_steps(steps: DataFrame, now) -> DataFrame:
    """Pending rows of the current step get their activation time.

    Rows which are active or not pending cannot change and pass without a lookup.
    """
    waiting = F.coalesce((F.col("status") == "pending") & F.col("activated_at").isNull(), F.lit(False))
    looked_up = lookup_join(steps.where(waiting), _open_minimum(steps, OPEN), ["request_id"])
    due = F.col("step_order") == F.col("current_step")
    activated = looked_up.withColumn("activated_at", F.when(due, as_timestamp(now))).select(*steps.columns)
    return steps.where(~waiting).unionByName(activated)


def sla_actions(
    steps: DataFrame,
    employees: DataFrame,
    now,
    *,
    remind_hours: float = REMIND_HOURS,
    designated_admin: str = DESIGNATED_ADMIN,
) -> DataFrame:
    """Late open steps with the action due: remind, or escalate to whom."""
    waited = hours_between(as_timestamp(now), F.col("activated_at"))
    action = F.when(waited >= remind_hours * ESCALATE_FACTOR, F.lit("escalate")).when(
        waited >= remind_hours, F.lit("remind")
    )
    late = (
        steps.where(_is_open() & F.col("activated_at").isNotNull())
        .withColumns({"waited_hours": waited, "action": action})
        .where(F.col("action").isNotNull())
    )
    managers = resolve_managers(employees).select(
        F.col("username").alias("approver_username"), "manager_username"
    )
    return late.join(managers, "approver_username", "left").select(
        F.col("id").alias("step_id"),
        "request_id",
        "step_order",
        "approver_username",
        "waited_hours",
        "action",
        F.when(F.col("action") == "escalate", F.coalesce("manager_username", F.lit(designated_admin))).alias("escalate_to"),
    )


def sla_counts(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count_if(F.col("action") == "remind").alias("reminded"),
        F.count_if(F.col("action") == "escalate").alias("escalated"),
    )


def escalation_rows(actions: DataFrame, steps: DataFrame, now) -> DataFrame:
    """New steps that escalation adds; a person already on the step is not added again."""
    keys = ["request_id", "step_order", "approver_username"]
    wanted = (
        actions.where(F.col("action") == "escalate")
        .select("request_id", "step_order", F.col("escalate_to").alias("approver_username"))
        .distinct()
    )
    return wanted.join(steps.select(*keys), keys, "left_anti").select(
        "request_id",
        "step_order",
        F.lit("escalated").alias("approver_role"),
        "approver_username",
        F.lit("pending").alias("status"),
        as_timestamp(now).alias("activated_at"),
    )


def escalate(
    steps: DataFrame,
    employees: DataFrame,
    now,
    *,
    remind_hours: float = REMIND_HOURS,
    designated_admin: str = DESIGNATED_ADMIN,
) -> DataFrame:
    """The whole step table after escalation: late rows are escalated, their new approvers are added.

    An escalated row is not open and a new one starts its time now, so a second
    run at the same time changes nothing.
    """
    actions = sla_actions(steps, employees, now, remind_hours=remind_hours, designated_admin=designated_admin)
    added = escalation_rows(actions, steps, now).withColumn(
        "id", F.concat_ws("/", F.col("request_id").cast("string"), F.col("step_order").cast("string"), "approver_username")
    )
    waited = hours_between(as_timestamp(now), F.col("activated_at"))
    late = F.coalesce(_is_open() & (waited >= remind_hours * ESCALATE_FACTOR), F.lit(False))
    after = steps.withColumn("status", F.when(late, F.lit("escalated")).otherwise(F.col("status")))
    return after.unionByName(
        added.select(*[c if c in added.columns else F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in steps.columns])
    )


def finalise(requests: DataFrame, steps: DataFrame, now) -> DataFrame:
    """Requests with their final status: only pending ones change, and get ``decided_at``.

    Requests without steps stay pending; a second run changes nothing.  The
    rows with ``decided_at`` = now and status approved are those to grant.
    """
    before = requests if "decided_at" in requests.columns else requests.withColumn("decided_at", F.lit(None).cast("timestamp"))
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    final = final_status(steps).where("status <> 'pending'").select(F.col("request_id").alias("id"), F.col("status").alias("__final"))
    decided = lookup_join(before.where(pending), final, ["id"]).withColumns(
        {
            "status": F.coalesce("__final", "status"),
            "decided_at": F.when(F.col("__final").isNotNull(), as_timestamp(now)).otherwise(F.col("decided_at")),
        }
    )
    return before.where(~pending).unionByName(decided.select(*before.columns))


def transfer_steps(steps: DataFrame, handover: DataFrame) -> DataFrame:
    """Hand open steps over: ``handover`` has (from_user, to_user); of several targets the least counts.

    Adds ``transfer``: "transferred"; "conflict" where the new approver is on
    that step already, or would be twice (the row stays as it is); null for
    rows not concerned.  Only the rows to move are compared with the others.
    """
    slot = ["request_id", "step_order", "__target"]
    pairs = (
        handover.where(F.col("from_user") != F.col("to_user"))
        .groupBy(F.col("from_user").alias("approver_username"))
        .agg(F.min("to_user").alias("__target"))
    )
    open_rows = steps.where(_is_open())
    # One lookup for the open rows; an approver with most of them is spread by it.
    targeted = lookup_join(open_rows, pairs, ["approver_username"])
    moving = targeted.where(F.col("__target").isNotNull())
    staying = targeted.where(F.col("__target").isNull()).select(*steps.columns)
    untouched = steps.where(~_is_open()).unionByName(staying)

    taken = steps.select("request_id", "step_order", F.col("approver_username").alias("__target"))
    doubled = moving.groupBy(*slot).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(*slot)
    blocked = taken.join(moving.select(*slot), slot, "left_semi").unionByName(doubled).distinct()
    checked = moving.join(blocked.withColumn("__blocked", F.lit(True)), slot, "left")
    stays = F.coalesce("__blocked", F.lit(False))
    moved = checked.withColumns(
        {
            "approver_username": F.when(stays, F.col("approver_username")).otherwise(F.col("__target")),
            "transfer": F.when(stays, F.lit("conflict")).otherwise(F.lit("transferred")),
        }
    ).select(*steps.columns, "transfer")
    return untouched.withColumn("transfer", F.lit(None).cast("string")).unionByName(moved)


def requests_with_steps(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Requests with their steps, one row per (request, step), in no order.

    The steps of a request stay rows: a request with very many of them is
    never gathered into one value, and the steps look their request up (not
    the other way round) so that they can be spread over tasks.  Requests
    without steps keep one row.
    """
    own = {"id": "step_id", "step_order": "step_order", "approver_username": "approver_username", "status": "step_status"}
    children = steps.select("request_id", *[F.col(c).alias(name) for c, name in own.items()])
    state = current_steps(steps).withColumn("__has_steps", F.lit(True))
    parents = requests.withColumnRenamed("id", "request_id").join(state, "request_id", "left")
    listed = lookup_join(children, parents.drop("__has_steps"), ["request_id"], "inner")
    lonely = parents.where(F.col("__has_steps").isNull()).drop("__has_steps")
    columns = [*parents.drop("__has_steps").columns, *own.values()]
    return listed.unionByName(lonely, allowMissingColumns=True).select(*columns)


def own_requests(requests: DataFrame, steps: DataFrame, most: int = 50) -> DataFrame:
    """Every user's newest requests, newest first, with their steps and the current step.

    ``position`` counts the requests of a user from the newest one.
    """
    page = first_of_each(requests, ["username"], [F.desc("id")], most)
    wanted = page.select(F.col("id").alias("request_id"))
    return requests_with_steps(page, rows_in(steps, wanted, ["request_id"]))


def own_registrations(registrations: DataFrame, most: int = 50) -> DataFrame:
    """Every user's newest registrations, newest first."""
    return first_of_each(registrations, ["requested_by"], [F.desc("id")], most)


def approved_transitions(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Approved requests with ``decided_at``, the time of their last step: what issues a grant, once."""
    last = steps.groupBy(F.col("request_id").alias("id")).agg(F.max("activated_at").alias("decided_at"))
    return lookup_join(approved_requests(requests, steps), last, ["id"], "inner").select(*requests.columns, "decided_at")


def decide_group_requests(requests: DataFrame, decisions: DataFrame, known_groups: DataFrame) -> DataFrame:
    """Group requests with their status after the decisions.

    Only a pending request can be decided, so its earliest decision counts.  An
    approval is applied when the group is known and waits for it otherwise.

    ``decisions``: request_id, verdict ("approve" or "reject"), decided_by, decided_at.
    """
    first = (
        decisions.where(F.col("verdict").isin("approve", "reject"))
        .groupBy(F.col("request_id").alias("id"))
        .agg(F.min(F.struct("decided_at", "decided_by", "verdict")).alias("__first"))
    )
    known = known_groups.select(F.col("group").alias("group_name")).distinct().withColumn("__known", F.lit(True))
    open_request = F.col("status") == "pending"
    looked_up = lookup_join(lookup_join(requests, first, ["id"]), known, ["group_name"])
    decided = open_request & F.col("__first").isNotNull()
    applied = F.when(F.col("__known"), F.lit("applied")).otherwise(F.lit("approved_pending_apply"))
    status = F.when(F.col("__first.verdict") == "approve", applied).otherwise(F.lit("rejected"))
    new = {
        "status": F.when(decided, status).otherwise(F.col("status")),
        "decided_by": F.when(decided, F.col("__first.decided_by")).otherwise(F.col("decided_by")),
        "decided_at": F.when(decided, F.col("__first.decided_at")).otherwise(F.col("decided_at")),
    }
    return looked_up.select(*[new.get(c, F.col(c)).alias(c) for c in requests.columns])


def pending_group_requests(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status") == "pending")


def granted_memberships(decided: DataFrame) -> DataFrame:
    """(username, group) of the applied requests."""
    return decided.where(F.col("status") == "applied").select("username", F.col("group_name").alias("group")).distinct()


def audit_page(requests: DataFrame, steps: DataFrame, limit: int = 200) -> DataFrame:
    """The newest requests with their steps."""
    page = requests.orderBy(F.desc("id")).limit(limit)
    wanted = page.select(F.col("id").alias("request_id"))
    listed = requests_with_steps(page, rows_in(steps, wanted, ["request_id"]))
    return listed.orderBy(F.desc("request_id"), "step_order", "step_id")


def full_audit_page(requests: DataFrame, steps: DataFrame, group_requests: DataFrame, limit: int = 200) -> DataFrame:
    """The newest table requests with their steps and the newest group requests on one page, marked by ``kind``."""
    tables = audit_page(requests, steps, limit).withColumn("kind", F.lit("table"))
    newest = group_requests.orderBy(F.desc("id")).limit(limit)
    groups = newest.select(
        F.lit("group").alias("kind"),
        F.col("id").alias("request_id"),
        *[c for c in ("username", "group_name", "status", "requested_at", "decided_by", "decided_at")],
    )
    return tables.unionByName(groups, allowMissingColumns=True)
