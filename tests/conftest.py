import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnwork.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def orders(spark):
    """The ten demo orders (fixed values)."""
    return spark.sql(
        """SELECT id AS order_id, c AS customer_name, r AS region, p AS product,
                  CAST(a AS DECIMAL(10,2)) AS amount, CAST(d AS DATE) AS order_date
        FROM VALUES (1L, 'Alice', 'East', 'Widget', '120.50', '2026-07-01'), (2L, 'Bob', 'West', 'Gadget', '85.00', '2026-07-03'),
        (3L, 'Carol', 'East', 'Widget', '60.25', '2026-07-05'), (4L, 'Dave', 'North', 'Gizmo', '200.00', '2026-07-10'),
        (5L, 'Eve', 'West', 'Widget', '45.75', '2026-07-12'), (6L, 'Frank', 'South', 'Gadget', '150.00', '2026-07-15'),
        (7L, 'Grace', 'East', 'Gizmo', '99.99', '2026-07-18'), (8L, 'Heidi', 'North', 'Widget', '75.50', '2026-07-20'),
        (9L, 'Ivan', 'South', 'Gadget', '130.00', '2026-07-22'), (10L, 'Judy', 'West', 'Gizmo', '110.25', '2026-07-25')
        AS t(id, c, r, p, a, d)"""
    )


@pytest.fixture(scope="session")
def employees(spark):
    """ceo <- director <- manager1 <- engineer1, engineer2; engineer3 has no manager."""
    rows = [
        ("E001", "ceo", ""),
        ("E002", "director", "E001"),
        ("E003", "manager1", "E002"),
        ("E004", "engineer1", "E003"),
        ("E005", "engineer2", "E003"),
        ("E006", "engineer3", ""),
        ("E007", "lost", "E999"),
    ]
    return spark.createDataFrame(
        [(i, u, u.title(), f"{u}@example.com", "dep", "t", m) for i, u, m in rows],
        "employee_id string, username string, name string, email string, department string, title string, manager_id string",
    )


def tuples(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
