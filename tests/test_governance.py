"""Golden cases of grants, policy, approvals, contracts, membership and catalogue."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.functions.names import DEFAULT_CATALOG, parse_table_name, schema_table
from tarnwork.plans import access, approvals, catalog, contracts, membership
from tarnwork.session import cut_lineage
from tests.conftest import tuples

NOW = datetime(2026, 8, 20)

# -- access policy -----------------------------------------------------------

GRANTS = [
    ("analyst001", "demo.access_test_l1", 1, "2026-08-14T00:00:00+00:00", "2099-01-01T00:00:00+00:00"),
    ("analyst001", "demo.expired_table", 1, "2020-01-01T00:00:00+00:00", "2020-06-01T00:00:00+00:00"),
]
GRANT_SCHEMA = "username string, table_fqn string, security_level int, granted_at string, expires_at string"
CASES = [
    ("table_registration_service", [], "CreateTable", None, True),
    ("superset_service", [], "SelectFromColumns", "demo.orders", True),
    ("dbt_demo_service", [], "CreateTable", None, True),
    ("platform_sdk_demo_service", [], "SelectFromColumns", "demo.orders", True),
    ("admin", ["platform-team"], "SelectFromColumns", "demo.no_grant_table", True),
    ("analyst001", ["data-analysts"], "ShowTables", None, True),
    ("analyst001", ["data-analysts"], "SelectFromColumns", "demo.access_test_l1", True),
    ("analyst001", ["data-analysts"], "SelectFromColumns", "demo.some_other_table", False),
    ("analyst001", ["data-analysts"], "SelectFromColumns", "demo.expired_table", False),
    ("algo001", ["algorithm-team"], "SelectFromColumns", "demo.access_test_l1", False),
    ("analyst001", ["data-analysts"], "ShowCreateTable", "demo.some_other_table", False),
    ("analyst001", ["data-analysts"], "CreateTable", "demo.new_table", False),
    ("analyst001", ["data-analysts"], "InsertIntoTable", "demo.access_test_l1", False),
]


@pytest.mark.parametrize("respect_granted_at", [True, False])
def test_policy_cases(spark, respect_granted_at):
    log = spark.createDataFrame(
        [(i, u, g, op, t, NOW) for i, (u, g, op, t, _) in enumerate(CASES)],
        "i int, user string, groups array<string>, operation string, table_fqn string, ts timestamp",
    )
    grants = spark.createDataFrame(GRANTS, GRANT_SCHEMA)
    decided = access.access_decisions(log, grants, respect_granted_at=respect_granted_at)
    assert dict(tuples(decided, "i", "allowed")) == {i: case[-1] for i, case in enumerate(CASES)}


def test_grant_matches_with_the_catalogue_in_front(spark):
    log = spark.createDataFrame(
        [("analyst001", ["x"], "SelectFromColumns", "trino.iceberg.demo.access_test_l1", NOW)],
        "user string, groups array<string>, operation string, table_fqn string, ts timestamp",
    )
    assert tuples(access.access_decisions(log, spark.createDataFrame(GRANTS, GRANT_SCHEMA)), "reason") == [("grant",)]


def test_grant_issued_later_counts_only_without_the_flag(spark):
    log = spark.createDataFrame(
        [("u", ["x"], "SelectFromColumns", "demo.t", datetime(2026, 1, 1))],
        "user string, groups array<string>, operation string, table_fqn string, ts timestamp",
    )
    grants = spark.createDataFrame([("u", "demo.t", 1, "2026-06-01T00:00:00+00:00", "")], GRANT_SCHEMA)
    assert tuples(access.access_decisions(log, grants), "allowed") == [(False,)]
    assert tuples(access.access_decisions(log, grants, respect_granted_at=False), "allowed") == [(True,)]


def test_expiry_boundary_blank_and_unreadable(spark):
    at = "2026-08-20T00:00:00+00:00"
    rows = [("at_now", at), ("blank", ""), ("junk", "soon"), ("year", "2020"), ("clock", "10:00"), ("past", "2020-02-01T00:00:00+00:00"), ("future", "2099-01-01T00:00:00+00:00")]
    grants = spark.createDataFrame([(n, "demo.t", 1, at, e) for n, e in rows], GRANT_SCHEMA)
    names = lambda df: {r[0] for r in tuples(df, "username")}
    assert names(access.expired_grants(grants, NOW)) == {"at_now", "past"}
    assert names(access.kept_grants(grants, NOW)) == {"blank", "junk", "year", "clock", "future"}
    assert names(access.active_grants(grants, NOW)) == {"at_now", "blank", "junk", "year", "clock", "future"}


def test_issued_grant_expires_after_180_days(spark):
    approved = spark.createDataFrame([("u", "demo.t", 2)], "username string, table_fqn string, security_level int")
    row = access.issue_grants(approved, F.lit(NOW)).first()
    assert row.expires_at - row.granted_at == timedelta(days=180)


# -- organisation and chains -------------------------------------------------


def test_managers(employees):
    got = dict(tuples(approvals.resolve_managers(employees), "username", "manager_username"))
    assert got == {
        "ceo": None, "director": "ceo", "manager1": "director", "engineer1": "manager1",
        "engineer2": "manager1", "engineer3": None, "lost": None,
    }


@pytest.mark.parametrize("levels,expected", [(1, ("manager1",)), (2, ("manager1", "director")), (3, ("manager1", "director", "ceo"))])
def test_chain_of_an_engineer(employees, levels, expected):
    chain = approvals.manager_chain(employees, levels).where("username = 'engineer1'")
    assert tuples(chain.drop("username")) == [expected]


def test_long_chain_ends_at_the_top(employees):
    chain = approvals.manager_chain(employees, 6).where("username = 'engineer1'")
    assert tuples(chain.drop("username")) == [("manager1", "director", "ceo", None, None, None)]


CHAINS = [
    ("engineer1", "someone-else-owner", 1, [(1, "manager", "manager1"), (1, "table_owner", "someone-else-owner")]),
    ("engineer1", "manager1", 1, [(1, "manager", "manager1")]),
    ("engineer1", "owner-x", 2, [(1, "manager", "manager1"), (1, "table_owner", "owner-x"), (2, "manager_manager", "director")]),
    ("engineer1", "director", 2, [(1, "manager", "manager1"), (1, "table_owner", "director")]),
    ("engineer1", "owner-x", 3, [
        (1, "manager", "manager1"), (1, "table_owner", "owner-x"), (2, "manager_manager", "director"), (3, "designated_admin", "admin"),
    ]),
    ("engineer1", "admin", 3, [(1, "manager", "manager1"), (1, "table_owner", "admin"), (2, "manager_manager", "director")]),
    ("director", "owner-x", 2, [(1, "manager", "ceo"), (1, "table_owner", "owner-x")]),
    ("engineer1", "", 1, [(1, "manager", "manager1")]),
    ("engineer3", "", 1, []),
    ("nobody", None, 1, []),
]
REQUEST = "id long, username string, table_fqn string, security_level int, table_owner string"


def test_approval_chains(spark, employees):
    requests = spark.createDataFrame([(i, u, "demo.t", lv, o) for i, (u, o, lv, _) in enumerate(CHAINS)], REQUEST)
    got = {}
    for rid, *step in tuples(approvals.approval_chain(requests, employees)):
        got.setdefault(rid, []).append(tuple(step))
    assert got == {i: steps for i, (_, _, _, steps) in enumerate(CHAINS) if steps}
    admitted = dict(tuples(approvals.admit_requests(requests, employees), "id", "status"))
    assert admitted == {i: "pending" if steps else "rejected" for i, (_, _, _, steps) in enumerate(CHAINS)}


def test_request_without_level_is_rejected(spark, employees):
    requests = spark.createDataFrame([(1, "engineer1", "demo.t", None, "owner")], REQUEST)
    row = approvals.admit_requests(requests, employees).first()
    assert (row.status, row.security_level, row.note) == ("rejected", 0, approvals.NO_LEVEL)
    assert approvals.approval_chain(requests, employees).count() == 0


# -- step states -------------------------------------------------------------

STEP = "id long, request_id long, step_order int, approver_role string, approver_username string, status string, decided_at timestamp, activated_at timestamp"


def steps(spark, rows):
    """rows: (id, request, step, approver, status, activated hours ago or None)"""
    return spark.createDataFrame(
        [(i, r, s, "manager", a, st, None, None if h is None else NOW - timedelta(hours=h)) for i, r, s, a, st, h in rows], STEP
    )


def test_full_chain_states(spark):
    rows = [(1, 1, 1, "manager1", "approved", 1), (2, 1, 1, "owner-x", "pending", 1), (3, 1, 2, "director", "pending", None)]
    df = steps(spark, rows)
    assert tuples(approvals.current_steps(df)) == [(1, 1)]
    assert tuples(approvals.final_status(df)) == [(1, "pending")]
    requests = spark.createDataFrame([(1, "engineer1", "demo.t", 2, "owner-x")], REQUEST)
    assert tuples(approvals.work_list(df, requests), "approver_username") == [("owner-x",)]
    assert approvals.work_list(df, requests, approver="director").count() == 0

    df = steps(spark, [rows[0], (2, 1, 1, "owner-x", "approved", 1), rows[2]])
    activated = approvals.activate_steps(df, NOW)
    assert dict(tuples(activated, "approver_username", "activated_at"))["director"] == NOW
    assert tuples(approvals.final_status(df.withColumn("status", F.lit("approved")))) == [(1, "approved")]


def test_two_meanings_of_current(spark):
    df = steps(spark, [(1, 1, 1, "a", "pending_external", 1), (2, 1, 2, "b", "pending", 1)])
    requests = spark.createDataFrame([(1, "engineer1", "demo.t", 2, "o")], REQUEST)
    assert approvals.work_list(df, requests).count() == 0
    assert tuples(approvals.work_list(df, requests, statuses=("pending",)), "approver_username") == [("b",)]


def test_rejection_skips_the_rest(spark):
    df = steps(spark, [(1, 1, 1, "a", "rejected", 1), (2, 1, 1, "b", "pending", 1), (3, 1, 2, "c", "pending_external", None), (4, 2, 1, "a", "pending", 1)])
    assert dict(tuples(approvals.final_status(df))) == {1: "rejected", 2: "pending"}
    assert dict(tuples(approvals.skip_after_reject(df), "id", "status")) == {1: "rejected", 2: "skipped", 3: "skipped", 4: "pending"}


def test_escalated_and_skipped_rows_do_not_block(spark):
    df = steps(spark, [(1, 1, 1, "a", "escalated", 1), (2, 1, 1, "b", "approved", 1), (3, 2, 1, "c", "skipped", 1)])
    assert dict(tuples(approvals.final_status(df))) == {1: "approved", 2: "pending"}


def test_sla_thresholds(spark, employees):
    df = steps(spark, [
        (1, 1, 1, "manager1", "pending", 47.9), (2, 2, 1, "manager1", "pending", 48), (3, 3, 1, "manager1", "pending", 60),
        (4, 4, 1, "manager1", "pending", 100), (5, 5, 1, "engineer3", "pending_external", 96), (6, 6, 1, "manager1", "approved", 500),
        (7, 7, 1, "manager1", "pending", None),
    ])
    actions = approvals.sla_actions(df, employees, NOW)
    assert dict((i, (a, to)) for i, a, to in tuples(actions, "step_id", "action", "escalate_to")) == {
        2: ("remind", None), 3: ("remind", None), 4: ("escalate", "director"), 5: ("escalate", "admin"),
    }
    assert tuples(approvals.sla_counts(actions)) == [(2, 2)]


def test_escalation_adds_a_person_once(spark, employees):
    df = steps(spark, [
        (1, 1, 1, "engineer1", "pending", 100), (2, 1, 1, "engineer2", "pending", 100),  # both go to manager1
        (3, 2, 1, "manager1", "pending", 100), (4, 2, 1, "director", "approved", 100),  # director is there already
    ])
    rows = approvals.escalation_rows(approvals.sla_actions(df, employees, NOW), df, NOW)
    assert tuples(rows, "request_id", "step_order", "approver_username", "approver_role") == [(1, 1, "manager1", "escalated")]


def test_transfer_of_steps(spark):
    df = steps(spark, [
        (1, 1, 1, "manager1", "pending", 1), (2, 2, 1, "manager1", "approved", 1), (3, 3, 1, "manager1", "pending_external", 1),
        (4, 3, 1, "manager2", "approved", 1), (5, 4, 1, "other", "pending", 1), (6, 5, 1, "x", "pending", 1), (7, 5, 1, "y", "pending", 1),
    ])
    handover = spark.createDataFrame([("manager1", "manager2"), ("x", "z"), ("y", "z"), ("q", "q")], "from_user string, to_user string")
    got = {i: (a, t) for i, a, t in tuples(approvals.transfer_steps(df, handover), "id", "approver_username", "transfer")}
    assert got == {
        1: ("manager2", "transferred"), 2: ("manager1", None), 3: ("manager1", "conflict"), 4: ("manager2", None),
        5: ("other", None), 6: ("x", "conflict"), 7: ("y", "conflict"),
    }


def test_audit_page_is_newest_first_with_ordered_steps(spark):
    requests = spark.createDataFrame([(i, "u", "demo.t", 1, "o") for i in range(1, 6)], REQUEST)
    df = steps(spark, [(2, 5, 2, "b", "pending", None), (1, 5, 1, "a", "approved", 1), (3, 4, 1, "c", "pending", 1), (9, 1, 1, "z", "pending", 1)])
    page = approvals.audit_page(requests, df, limit=3)
    assert tuples(page, "request_id", "step_id", "current_step") == [(5, 1, 2), (5, 2, 2), (4, 3, 1), (3, None, None)]


# -- contracts ---------------------------------------------------------------

TEXTS = [
    ("order_id BIGINT", [("order_id", "BIGINT")], None),
    ("order_id BIGINT\nname VARCHAR(100)\namount DOUBLE", [("order_id", "BIGINT"), ("name", "VARCHAR(100)"), ("amount", "DOUBLE")], None),
    ("order_id BIGINT\n\n\nname VARCHAR(50)", [("order_id", "BIGINT"), ("name", "VARCHAR(50)")], None),
    ("id bigint", [("id", "BIGINT")], None),
    ("price VARCHAR(10, 2)", [("price", "VARCHAR(10, 2)")], None),
    ("  a\u00a0\u3000int \r\nb\tdate\u2028c real", [("a", "INT"), ("b", "DATE"), ("c", "REAL")], None),
    ("a INT\u2028b DATE\x1cc REAL", [("a", "INT"), ("b", "DATE"), ("c", "REAL")], None),
    ("order_id", None, (1, contracts.BAD_FORMAT)),
    ("1id BIGINT", None, (1, contracts.BAD_NAME)),
    ("id;DROP_TABLE BIGINT", None, (1, contracts.BAD_NAME)),
    ("id BIGINT); DROP TABLE users; --", None, (1, contracts.BAD_TYPE)),
    ("data JSON", None, (1, contracts.BAD_TYPE)),
    ("", None, (None, contracts.NO_COLUMNS)),
    ("   \n  \n", None, (None, contracts.NO_COLUMNS)),
    ("id BIGINT\nbad_line_no_type", None, (2, contracts.BAD_FORMAT)),
    ("id BIGINT\n\nx JSON\ny", None, (3, contracts.BAD_TYPE)),
    (None, None, (None, contracts.NO_COLUMNS)),
]


def test_contracts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "id int, raw string")
    checked = contracts.check_contracts(df, "raw", extra_types=())
    accepted = {}
    for i, position, name, kind in sorted(tuples(contracts.accepted_columns(checked, ["id"]))):
        accepted.setdefault(i, []).append((name, kind))
    assert accepted == {i: cols for i, (_, cols, _) in enumerate(TEXTS) if cols}
    rejected = {i: (line, why) for i, line, why in tuples(contracts.rejected_contracts(checked, ["id"]))}
    assert rejected == {i: err for i, (_, _, err) in enumerate(TEXTS) if err}


def test_decimal_is_accepted_by_choice_only(spark):
    df = spark.createDataFrame([(1, "amount DECIMAL(10,2)")], "id int, raw string")
    assert contracts.accepted_columns(contracts.check_contracts(df, "raw"), ["id"]).count() == 1
    assert contracts.accepted_columns(contracts.check_contracts(df, "raw", extra_types=()), ["id"]).count() == 0


def test_catalogue_types(spark):
    df = spark.createDataFrame([("a", "INTEGER"), ("b", "REAL"), ("c", "VARCHAR(40)"), ("d", "CHAR"), ("e", "GEOMETRY"), ("f", "DATE")], "name string, type string")
    got = {n: (t, length) for n, t, length in tuples(contracts.catalog_columns(df), "name", "catalog_type", "data_length")}
    assert got == {"a": ("INT", None), "b": ("FLOAT", None), "c": ("VARCHAR", 40), "d": ("CHAR", 255), "e": ("VARCHAR", 255), "f": ("DATE", None)}


NAMES = [
    ("demo.orders", (DEFAULT_CATALOG, "demo", "orders")),
    ("iceberg.demo.orders", ("iceberg", "demo", "orders")),
    ("  demo.orders  ", (DEFAULT_CATALOG, "demo", "orders")),
    ("orders", None),
    ("a.b.c.d", None),
    ("demo.orders; DROP TABLE x", None),
]


def test_table_names(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "n string").select("n", parse_table_name(F.col("n")).alias("p"))
    for name, catalog_, schema, table, error in tuples(df, "n", "p.catalog", "p.schema", "p.table", "p.error"):
        expected = dict(NAMES)[name]
        assert ((catalog_, schema, table) if error is None else None) == expected


def test_short_name(spark):
    df = spark.createDataFrame([("trino.iceberg.demo.orders",), ("demo.orders",), ("orders",)], "n string")
    assert [r[0] for r in tuples(df.select(schema_table(F.col("n"))))] == ["demo.orders", "demo.orders", "orders"]


# -- membership and catalogue ------------------------------------------------


def test_membership_drift(spark):
    m = lambda *rows: spark.createDataFrame(list(rows), "username string, group string")
    desired = m(("a", "g1"), ("a", "g1"), ("b", "g1"), ("c", "gX"))
    current = m(("b", "g1"), ("d", "g1"), ("e", "gX"))
    known = spark.createDataFrame([("g1",), ("g2",)], "group string")
    assert tuples(membership.to_add(desired, current, known)) == [("a", "g1")]
    assert tuples(membership.to_remove(desired, current, known)) == [("d", "g1")]
    assert tuples(membership.unknown_groups(desired, known)) == [("gX",)]
    handover = spark.createDataFrame([("b", "c")], "from_user string, to_user string")
    assert sorted(tuples(membership.transfer(current.unionByName(m(("b", "g2"), ("c", "g2"))), handover))) == [
        ("b", "g1"), ("b", "g2"), ("c", "g1"), ("c", "g2"), ("d", "g1"), ("e", "gX"),
    ]
    assert sorted(tuples(membership.upsert(current, m(("b", "g1"), ("z", "g1"))))) == [("b", "g1"), ("d", "g1"), ("e", "gX"), ("z", "g1")]


def test_governance_of_entities(spark):
    docs = [
        '{"fullyQualifiedName":"trino.iceberg.demo.a","tags":[{"tagFQN":"SecurityLevel.Level2"},{"tagFQN":"SecurityLevel.LevelX"}],"owners":[{"type":"team","name":"t"},{"type":"user","name":"u"}],"columns":[{"name":"c"}]}',
        '{"fullyQualifiedName":"trino.iceberg.demo.b","extension":{"securityLevel":3,"registeredOwner":"r"}}',
        '{"fullyQualifiedName":"solo"}',
    ]
    rows = catalog.entity_rows(spark.createDataFrame([(d,) for d in docs], "doc_json string"))
    assert sorted(tuples(rows, "fqn", "schema", "security_level", "owner"), key=str) == sorted(
        [("trino.iceberg.demo.a", "demo", 2, "u"), ("trino.iceberg.demo.b", "demo", 3, "r"), ("solo", "", None, None)], key=str
    )
    assert tuples(catalog.search(rows, keyword="DEMO.", level=3), "fqn") == [("trino.iceberg.demo.b",)]
    assert tuples(catalog.search(rows, schema="demo"), "fqn") == [("trino.iceberg.demo.a",), ("trino.iceberg.demo.b",)]


def test_lineage_from_job_configuration(spark):
    config = '{"env":{"job.mode":"batch"},"sink":[{"plugin_name":"Iceberg","namespace":"demo","table":"device_events"},{"plugin_name":"Console"}]}'
    runs = spark.createDataFrame([("p", config), ("p", config), ("q", '{"sink":[]}'), ("r", "no json")], "pipeline_id string, config_json string")
    sinks = catalog.sink_tables(runs)
    assert tuples(sinks) == [("p", "trino.iceberg.demo.device_events")]
    known = spark.createDataFrame([("trino.iceberg.demo.other", "1")], "table_fqn string, table_id string")
    assert catalog.lineage_edges(sinks, known).count() == 0
    assert catalog.unresolved_sinks(sinks, known).count() == 1


def test_scan_difference(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "table_name string, signature string")
    got = dict(tuples(catalog.scan_difference(t(("a", "1"), ("b", "1"), ("c", "1")), t(("b", "1"), ("c", "2"), ("d", None)))))
    assert got == {"a": "deleted", "c": "changed", "d": "new"}


# -- decisions ---------------------------------------------------------------


def decide(spark, df, *decisions, external=False):
    made = spark.createDataFrame(list(decisions), "step_id long, username string, decision string")
    judged = approvals.judge_decisions(df, made, external=external)
    # Every round of decisions is a job whose result is stored.
    decided = cut_lineage(approvals.apply_decisions(df, judged, NOW))
    return dict(tuples(judged, "step_id", "outcome")), cut_lineage(approvals.activate_steps(decided, NOW))


def test_two_level_approval(spark):
    df = steps(spark, [(1, 1, 1, "manager1", "pending", 1), (2, 1, 1, "owner-x", "pending", 1), (3, 1, 2, "director", "pending", None)])
    outcome, df = decide(spark, df, (3, "director", "approved"), (1, "manager1", "approved"), (2, "someone-else", "approved"), (9, "x", "approved"))
    assert outcome == {3: "not its turn", 1: "applied", 2: "forbidden", 9: "forbidden"}
    assert tuples(approvals.final_status(df)) == [(1, "pending")]
    assert dict(tuples(df, "id", "activated_at"))[3] is None
    outcome, df = decide(spark, df, (1, "manager1", "approved"), (2, "owner-x", "approved"))
    assert outcome == {1: "forbidden", 2: "applied"}  # already decided
    assert dict(tuples(df, "id", "activated_at"))[3] == NOW
    _, df = decide(spark, df, (3, "director", "approved"))
    assert tuples(approvals.final_status(df)) == [(1, "approved")]
    assert dict(tuples(df, "id", "decided_at"))[3] == NOW


def test_reject_ends_the_request(spark):
    df = steps(spark, [(1, 1, 1, "manager1", "pending", 1), (2, 1, 1, "owner-x", "pending", 1), (3, 1, 2, "director", "pending", None)])
    outcome, df = decide(spark, df, (3, "director", "rejected"))
    assert outcome == {3: "applied"}
    assert dict(tuples(df, "id", "status")) == {1: "skipped", 2: "skipped", 3: "rejected"}


def test_external_decisions(spark):
    df = steps(spark, [(1, 1, 1, "manager1", "pending_external", 1), (2, 2, 1, "owner-x", "pending", 1)])
    outcome, df = decide(spark, df, (1, None, "approved"), (2, None, "approved"), external=True)
    assert outcome == {1: "applied", 2: "forbidden"}
    assert dict(tuples(approvals.final_status(df))) == {1: "approved", 2: "pending"}


def test_duplicate_staff_and_blank_managers(spark):
    import random

    order = random.Random(3)
    staff = [(f"E{order.randrange(40)}", order.choice(["", *(f"u{k}" for k in range(30))]), order.choice(["", None, *(f"E{k}" for k in range(45))])) for _ in range(120)]
    employees = spark.createDataFrame([(i, u, u, "", "", "", m) for i, u, m in staff], "employee_id string, username string, name string, email string, department string, title string, manager_id string")
    requests = spark.createDataFrame(
        [(k, f"u{k % 35}", "demo.t", order.choice([1, 2, 3, None]), order.choice(["", None, "owner"])) for k in range(200)],
        "id long, username string, table_fqn string, security_level int, table_owner string",
    )
    admitted = approvals.admit_requests(requests, employees)
    assert admitted.count() == 200
    chain = approvals.approval_chain(requests, employees)
    assert chain.groupBy("request_id", "step_order", "approver_username").count().where("count > 1").count() == 0
    with_step = {r.request_id for r in chain.select("request_id").distinct().collect()}
    assert {r.id for r in admitted.where("status = 'pending'").collect()} == with_step


def test_escalation_and_final_status_are_stable(spark):
    from datetime import datetime

    steps = spark.createDataFrame(
        [
            ("1/1/a", 1, 1, "a", "pending", datetime(2026, 1, 1)),
            ("2/1/a", 2, 1, "a", "approved", datetime(2026, 1, 1)),
            ("3/1/b", 3, 1, "b", "pending", datetime(2026, 1, 9, 12)),
        ],
        "id string, request_id int, step_order int, approver_username string, status string, activated_at timestamp",
    )
    employees = spark.createDataFrame([("E1", "a", "a", "E2"), ("E2", "boss", "boss", "")], "employee_id string, username string, name string, manager_id string")
    once = approvals.escalate(steps, employees, "2026-01-10")
    rows = sorted((r.id, r.status) for r in once.collect())
    assert rows == [("1/1/a", "escalated"), ("1/1/boss", "pending"), ("2/1/a", "approved"), ("3/1/b", "pending")]
    assert sorted((r.id, r.status) for r in approvals.escalate(once, employees, "2026-01-10").collect()) == rows
    requests = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "rejected"), (4, "pending")], "id int, status string")
    final = approvals.finalise(requests, once, "2026-01-10")
    rows = sorted((r.id, r.status, r.decided_at is not None) for r in final.collect())
    assert rows == [(1, "pending", False), (2, "approved", True), (3, "rejected", False), (4, "pending", False)]
    assert sorted((r.id, r.status, r.decided_at is not None) for r in approvals.finalise(final, once, "2026-01-11").collect()) == rows


def test_two_targets_for_one_person_move_a_step_once(spark):
    steps = spark.createDataFrame(
        [("s1", 1, 1, "a", "pending"), ("s2", 2, 1, "b", "pending")], "id string, request_id int, step_order int, approver_username string, status string"
    )
    handover = spark.createDataFrame([("a", "y"), ("a", "x")], "from_user string, to_user string")
    rows = sorted((r.id, r.approver_username, r.transfer) for r in approvals.transfer_steps(steps, handover).collect())
    assert rows == [("s1", "x", "transferred"), ("s2", "b", None)]
