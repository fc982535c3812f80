"""Appends that happen once, own lists, group requests, refreshes and CSV files by header."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork import schemas
from tarnwork.operators.keyed import first_of_each
from tarnwork.plans import approvals
from tarnwork.session import scratch_path
from tarnwork.sinks import once
from tarnwork.sinks import tables as sinks
from tarnwork.sources import tables as sources
from tests.conftest import tuples

T0 = datetime(2026, 8, 1)
SCHEMA = "id long, at timestamp, note string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, None if d is None else T0 + timedelta(days=d), n) for i, d, n in rows], SCHEMA)


def test_a_second_run_adds_nothing(spark):
    root, first = scratch_path(spark, "once"), frame(spark, (1, 0, "a"), (2, 40, "b"), (1, 0, "z"), (3, None, "c"))
    assert once.append_once(first, root, "1", ["id", "at"], "at") == 3
    assert once.append_once(first, root, "1", ["id", "at"], "at") is None
    # Another run that overlaps: the same transition is left out, the same id at another time is not.
    assert once.append_once(frame(spark, (2, 40, "again"), (2, 41, "new"), (3, None, "x")), root, "2/a b", ["id", "at"], "at") == 1
    got = sorted(tuples(once.read_once(spark, root, first.schema), "id", "note"))
    assert got == [(1, "a"), (2, "b"), (2, "new"), (3, "c")]
    assert once.append_once(first.limit(0), root, "3", ["id", "at"], "at") == 0
    assert once.read_once(spark, root, first.schema).count() == 4


def test_run_names_do_not_meet():
    assert len({once._run_name(x) for x in ("a/b", "a_b", "a b", "a_2f_b", "", "r", "rr", "/")}) == 8


@pytest.mark.parametrize("place", ["rows", "marks"])
def test_a_run_that_failed_is_written_anew(spark, place, monkeypatch):
    """Without its mark a run is not seen, and its rows are replaced by the next try."""
    from pyspark.sql.readwriter import DataFrameWriter

    root, rows = scratch_path(spark, "once"), frame(spark, (1, 0, "a"), (2, 1, "b"))
    once.append_once(frame(spark, (1, 0, "a")), root, "first", ["id", "at"], "at")
    write = DataFrameWriter.parquet

    def broken(self, path, *a, **k):
        if place == "rows" and "/rows/" in path:
            write(self, path, *a, **k)
            raise OSError("lost")
        if place == "marks" and "/marks/" in path:
            raise OSError("lost")
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        once.append_once(rows, root, "second", ["id", "at"], "at")
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert once.read_once(spark, root, rows.schema).count() == 1
    assert once.append_once(rows, root, "second", ["id", "at"], "at") == 1
    assert sorted(tuples(once.read_once(spark, root, rows.schema), "id")) == [(1,), (2,)]


def test_first_rows_of_each_key_are_limited_before_the_exchange(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    page = first_of_each(rows, ["k"], [F.desc("id")], 2)
    assert sorted(tuples(page.select("k", "position", "id"))) == [(k, p, 3000 - 3 * p + k) for k in range(3) for p in (1, 2)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hash") < plan.rindex("WindowGroupLimit")


def test_group_requests_are_decided_once(spark):
    kind = "id long, username string, group_name string, status string, requested_at timestamp, decided_by string, decided_at timestamp"
    requests = [(i, f"u{i}", "known" if i != 2 else "new", "pending", T0, None, None) for i in range(1, 5)]
    requests += [(5, "u5", "known", "rejected", T0, "boss", T0)]
    at = lambda h: T0 + timedelta(hours=h)
    decisions = [(1, "approve", "a", at(1)), (1, "reject", "b", at(2)), (2, "approve", "a", at(1)), (3, "reject", "a", at(1)),
                 (5, "approve", "a", at(1)), (9, "approve", "a", at(1)), (4, "maybe", "a", at(1))]
    decided = approvals.decide_group_requests(
        spark.createDataFrame(requests, kind),
        spark.createDataFrame(decisions, "request_id long, verdict string, decided_by string, decided_at timestamp"),
        spark.createDataFrame([("known",), ("known",)], "group string"),
    )
    assert sorted(tuples(decided, "id", "status", "decided_by")) == [
        (1, "applied", "a"), (2, "approved_pending_apply", "a"), (3, "rejected", "a"), (4, "pending", None), (5, "rejected", "boss"),
    ]
    assert tuples(approvals.pending_group_requests(decided), "id") == [(4,)]
    assert tuples(approvals.granted_memberships(decided)) == [("u1", "known")]


def test_own_requests_are_the_newest(spark):
    requests = spark.createDataFrame([(i, f"u{i % 2}", T0) for i in range(1, 8)], "id long, username string, requested_at timestamp")
    steps = spark.createDataFrame(
        [(i * 10 + s, i, s, "boss", "approved" if s == 1 else "pending", T0) for i in range(1, 8) for s in (1, 2) if i != 7],
        "id long, request_id long, step_order int, approver_username string, status string, activated_at timestamp",
    )
    got = tuples(approvals.own_requests(requests, steps, most=2), "username", "position", "request_id", "step_order", "current_step")
    assert sorted(got, key=str) == sorted(
        [("u0", 1, 6, 1, 2), ("u0", 1, 6, 2, 2), ("u0", 2, 4, 1, 2), ("u0", 2, 4, 2, 2), ("u1", 1, 7, None, None), ("u1", 2, 5, 1, 2), ("u1", 2, 5, 2, 2)],
        key=str,
    )


def test_refresh_is_seen_as_a_whole(spark):
    root = scratch_path(spark, "refresh")
    for n in (3, 5, 4):
        sinks.refresh(spark.range(n), root)
        assert sinks.read_snapshot(spark, root).count() == n
    assert sinks.snapshot_versions(spark, root) == [2, 3]
    sinks.refresh(sinks.read_snapshot(spark, root).where("id > 0"), root)  # reads what it replaces
    assert sinks.read_snapshot(spark, root).count() == 3
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        sinks.refresh(spark.range(3).select((F.col("id") / F.lit(0)).alias("id")), root)
    assert sinks.read_snapshot(spark, root).count() == 3


def test_files_of_a_folder_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("username,group\nalice,g1\n")
    (tmp_path / "b.csv").write_text("group,username\ng2,bob\n")
    (tmp_path / "c.csv").write_text("group,username\ng3,carol\ng4,dave\n")
    (tmp_path / "d.csv").write_text("username\nerin\n")
    (tmp_path / "e.csv").write_text("")
    got = tuples(sources.read_memberships(spark, str(tmp_path)))
    assert sorted(got, key=str) == [("alice", "g1"), ("bob", "g2"), ("carol", "g3"), ("dave", "g4"), ("erin", None)]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.csv").write_text("")
    assert sources.read_csv(spark, str(empty), schemas.MEMBERSHIPS).count() == 0
