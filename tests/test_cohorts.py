"""The walk of one side: a case for each reason, and what the bytes decide."""

import os

import duckdb
import pytest

from spindrift.plans import cohorts

PLAIN = dict.fromkeys(("excluded", "settling", "unreadable", "other_workspace", "spans_application", "lifecycle_session"), False)


def walk(*rows, most=10, side=1000, session=400):
    s = cohorts.Side(most, side, session)
    return [s.decide({**PLAIN, "bytes": 100, **r}) for r in rows], s


@pytest.mark.parametrize("flag,reason", [("excluded", "evidence-session"), ("settling", "still-settling"), ("unreadable", "unreadable"), ("other_workspace", "other-workspace"), ("spans_application", "spans-application"), ("lifecycle_session", "lifecycle-session")])
def test_reasons(flag, reason):
    got, s = walk({flag: True}, {})
    assert got == [reason, "accepted"]
    assert (s.spent, s.read) == {"excluded": (100, 100), "settling": (100, 200)}.get(flag, (200, 200))


def test_a_session_over_its_own_cap_does_not_stop_the_side():
    assert walk({"bytes": 401}, {})[0] == ["over-budget", "accepted"]


def test_a_spent_budget_stops_the_side_and_completes_it():
    got, s = walk({"bytes": 400}, {"bytes": 400}, {"bytes": 201}, {"bytes": 1})
    assert got == ["accepted", "accepted", "budget-spent", None] and s.complete
    got, s = walk({"bytes": 400}, {"bytes": 400}, {"bytes": 200}, {"bytes": 1}, {})
    assert got == ["accepted"] * 3 + ["budget-spent", None] and s.complete


def test_bytes_of_settling_sessions_stop_but_do_not_complete():
    got, s = walk({"bytes": 400, "settling": True}, {"bytes": 400}, {"bytes": 300}, {})
    assert got == ["still-settling", "accepted", "budget-spent", None] and not s.complete
    got, s = walk(*[{"bytes": 250, "settling": True}] * 4, {})
    assert got[-1] == "budget-spent" and not s.complete


def test_at_most_so_many():
    got, s = walk({}, {}, {}, most=2)
    assert got == ["accepted", "accepted", None] and s.complete


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_the_tables_meet_every_reason():
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    met = {d for (d,) in con.sql(f"SELECT DISTINCT decision FROM ({cohorts.ORACLE['cohort_walk']})").fetchall()}
    assert met == {*cohorts.REASONS, "accepted"}
    rows = con.sql(f"SELECT first_waits, later_complete FROM ({cohorts.ORACLE['cohorts_graded']})").fetchall()
    assert {w for w, _ in rows} == {True, False} == {c for _, c in rows}
