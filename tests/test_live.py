"""Open calls and live facts: cases of the state, taken one by one."""

import pytest
from pyspark.sql import Row

from spindrift.streaming.live import TURNS, LiveFacts


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class Map(dict):
    def updateValue(self, k, v):
        self[k] = v

    def getValue(self, k):
        return self[k]

    def containsKey(self, k):
        return k in self

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *a):
        return Value()

    getListState = getValueState

    def getMapState(self, *a):
        return Map()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def run(*batches):
    p = LiveFacts()
    p.init(Handle())
    n, out = 0, None
    for batch in batches:
        rows = []
        for a in batch:
            n += 1
            rows.append(Row(ord=n, at=n * 1000, **{**dict.fromkeys(("kind", "id", "tool", "text", "path", "status", "tokens")), **a}))
        (out,) = p.handleInputRows(("s",), iter(rows[::-1]), None)
    return p, out


def call(i, **more):
    return {"kind": "call", "id": i, "tool": "Bash", **more}


RESULT, PROMPT = {"kind": "result", "id": "a"}, {"kind": "prompt", "text": "go"}


@pytest.mark.parametrize("split", [False, True])
def test_a_result_closes_its_call_also_in_a_later_batch(split):
    rows = [PROMPT, call("a"), call("b"), RESULT]
    _, r = run(*([[x] for x in rows] if split else [rows]))
    assert (r.closed_calls, r.closed_ms, r.open_calls, r.late_results, r.turns) == (1, 2000, "b", 0, 1)


def test_a_new_turn_closes_calls_and_a_late_result_has_no_call():
    _, r = run([PROMPT, call("a", status="subagent"), PROMPT, RESULT, {"kind": "result", "id": "never"}])
    assert (r.closed_calls, r.dropped_calls, r.late_results, r.open_calls, r.ended_tasks, r.running_tasks) == (0, 1, 2, "", 1, "")


def test_a_launched_task_ends_with_a_status_only():
    given = [PROMPT, call("a", status="background"), {**RESULT, "status": "launched"}, PROMPT, {"kind": "notification", "id": "a"}]
    assert run(given)[1].running_tasks == "a"
    _, r = run(given, [{"kind": "notification", "id": "a", "status": "ended"}])
    assert (r.running_tasks, r.ended_tasks, r.closed_calls) == ("", 1, 1)


def test_question_errors_files_links_and_the_ring_of_turns():
    ask = {"kind": "call", "id": "q", "tool": "AskUserQuestion"}
    _, r = run([PROMPT, ask, {"kind": "error", "status": "api-error", "text": "x"}, call("e", tool="Edit", path="f"), call("e2", tool="Write", path="f"), {"kind": "pr", "text": "u"}, {"kind": "pr", "text": "u"}])
    assert (r.question, r.error, r.files, r.links) == ("q", "api-error", "f:Write:5000", "u")
    assert run([PROMPT, ask, {"kind": "error", "status": "api-error"}, {"kind": "clear"}])[1].error is None
    _, r = run([{"kind": "prompt", "text": str(k)} for k in range(TURNS + 3)])
    assert r.history.split("|")[0].startswith("3>") and len(r.history.split("|")) == TURNS
    assert run([{"kind": "reply", "text": "hello"}, {"kind": "turn-end"}])[1].history == "->5>2000"


def test_a_quiet_session_gives_one_last_row_and_its_state():
    p, r = run([PROMPT, call("a")])
    (last,) = p.handleExpiredTimer(("s",), None, None)
    assert last.ended and last.open_calls == "a" and not r.ended
    assert not p.facts.exists() and not p.open and p.handle.timers == [2000 + 1_800_000]


def test_a_board_is_given_out_only_when_it_says_something_new(spark, tmp_path):
    from spindrift.streaming.board import BOARD, PLACES, SESSION, Boards

    def batch(*rows):
        return spark.createDataFrame([(s, turns, 0, 0, "", at) for s, turns, at in rows], SESSION)

    b = Boards(f"file://{tmp_path}")
    b.take(batch(*[(f"s{k:02d}", 1, 1000 + k) for k in range(10)]), 0)
    b.take(batch(("s09", 1, 5000)), 1)  # a time alone
    b.take(batch(("s00", 1, 1001)), 2)  # behind the eighth place
    b.take(batch(("s09", 2, 5001)), 3)
    b.take(batch(("late", 1, 50_000_000)), 4)  # all others have fallen quiet
    got = {}
    for r in spark.read.schema(BOARD).parquet(f"{tmp_path}/boards").collect():
        got.setdefault(r.batch, []).append((r.place, r.session, r.turns))
    assert sorted(got) == [0, 3, 4] and len(got[0]) == PLACES and sorted(got[3])[0] == (1, "s09", 2) and got[4] == [(1, "late", 1)]


def test_boards_are_the_same_however_many_files_a_part_has(spark, tmp_path):
    from pyspark.sql import functions as F

    from spindrift.streaming.board import boards_of_landed, land

    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = spark.range(1000).selectExpr("concat('s', id % 50) as session", "id as number", "'x' as line", "cast(id % 4 = 3 as int) as part")
    lines, files = land(rows, str(tmp_path), 2, 100)
    assert (files, lines.count()) == (8, 1000)
    for k, n in ((0, 750), (1, 250)):
        part = spark.read.parquet(f"{tmp_path}/landing/part-{k:03d}")
        assert (len(part.inputFiles()), part.count()) == (8, n)
        assert max(r["count"] for r in part.groupBy(F.input_file_name()).count().collect()) < 200
    one, many = (sorted(map(tuple, boards_of_landed(talks, rows_per_file=n).collect())) for n in (10**6, 40))
    assert one == many and one
