"""Reverts: one case for each exclusion. Serial agents against a quadratic form. Edits by hand."""

import random

import pytest

from spindrift.plans import work_patterns as wp

SCHEMA = (
    "session_id string, ord long, turn_index int, agent_id string, at long, duration_ms long, is_error boolean, message_id string, command string, tool string, cwd string, file string,"
    " old string, new string, unresolved boolean, prompt string, preview string, name string, spawned string"
)
NAMES = [f.split()[0] for f in SCHEMA.replace(", ", ",").split(",")]


def calls(spark, rows):
    base = dict.fromkeys(NAMES) | {"session_id": "s", "turn_index": 5, "at": 0, "duration_ms": 1, "is_error": False, "cwd": "/w/p", "unresolved": False}
    return spark.createDataFrame([tuple((base | {"ord": n, "message_id": f"m{n}"} | r)[c] for c in NAMES) for n, r in enumerate(rows)], SCHEMA)


EDIT = {"tool": "Edit", "file": "/w/a.py", "old": "", "new": ""}


def bash(command, **more):
    return {"tool": "Bash", "command": command, **more}


CASES = [
    ("revert", [bash("git revert HEAD")], ["revert"]), ("quoted", [bash("echo 'x && git revert HEAD'")], []), ("restore", [bash("git restore a")], ["restore"]), ("unstaged", [bash("git restore --staged a")], []),
    ("reset", [bash("git reset --hard")], ["reset-hard"]), ("soft reset", [bash("git reset HEAD~1")], []), ("reset to base", [bash("git reset --hard origin/x")], ["reset-hard"]), ("base in an early turn", [bash("git reset --hard main", turn_index=2)], []),
    ("base in a worktree", [bash("git reset --hard main", cwd="/w/worktrees/t")], []), ("base in a worktree named by the command", [bash("cd /w/.worktree/t && git reset --hard main")], []), ("checkout", [bash("git checkout -- a")], ["checkout"]),
    ("checkout of HEAD", [bash("git checkout HEAD~2 -- a")], ["checkout"]), ("checkout of a ref", [bash("git checkout dev -- a")], []), ("branch", [bash("git checkout dev")], []), ("ritual", [bash("git checkout -- a")] * 3, []), ("twice", [bash("git checkout -- a")] * 2, ["checkout"] * 2),
    ("stash before an edit", [bash("git stash"), EDIT], []), ("stash", [EDIT, bash("git stash")], ["stash"]), ("stash list", [EDIT, bash("git stash list")], []), ("stash put back", [EDIT, bash("git stash"), bash("git stash pop")], []),
    ("stash in a worktree", [EDIT, bash("git stash", cwd="/w/worktrees/t")], []), ("two in one call", [bash("git revert a && git restore b")], ["revert,restore"]), ("other program", [bash("/usr/bin/git revert a; hg revert b")], ["revert"]),
]


@pytest.fixture(scope="module")
def reverts(spark):
    frame = None
    for name, rows, _ in CASES:
        part = calls(spark, [{"session_id": name, **r} for r in rows])
        frame = part if frame is None else frame.union(part)
    out = {}
    for r in wp.revert_calls(frame.coalesce(2)).orderBy("ord").collect():
        out.setdefault(r.session_id, []).append(r.kinds)
    return out


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_reverts(reverts, case):
    assert reverts.get(case[0], []) == case[2]


def test_a_revert_after_a_failed_test_of_its_turn(spark):
    rows = [bash("pytest", is_error=True), bash("git revert a"), bash("git restore x", turn_index=6), bash("npm test", turn_index=7), bash("ls", is_error=True, turn_index=7), bash("git revert b", turn_index=7)]
    assert [r.after_failed_test for r in wp.revert_calls(calls(spark, rows)).orderBy("ord").collect()] == [True, False, False]
    assert [(r.rule, r.severity) for r in wp.work_insights(calls(spark, rows)).collect()] == [("reverts", 2)]
    assert wp.work_insights(calls(spark, [bash("git revert a")])).count() == 0  # one alone is routine


def quadratic(items, least=3):
    """Runs by looking at every earlier result of a run, window by window."""
    out, run = [], []
    fold = lambda s: " ".join((s or "").split())

    def needs(a, b):
        p, r = fold(a["prompt"]), fold(b["preview"])
        return bool(b["spawned"] and b["spawned"] in p) or bool(b["name"] and len(b["name"]) >= 4 and b["name"] in p) or any(r[i : i + 16] in p for i in range(len(r) - 15))

    for x in [*items, None]:
        if x is None or not x["single"] or run and x["start"] < run[-1]["end"] or any(needs(x, y) for y in run):
            out += [run] if len(run) >= least else []
            run = []
        if x is not None and x["single"]:
            run = [*run, x]
    return out


def test_serial_agents_equal_a_quadratic_form():
    rng = random.Random(4)
    texts = ["the scan of module one found nothing", "see  module two,\n please", "report", "module one found nothing new", "ask ag3 again", "as Scout said", None]
    for _ in range(400):
        items = [{"prompt": rng.choice(texts), "preview": rng.choice(texts), "name": rng.choice([None, "Loo", "Scout"]), "spawned": rng.choice([None, "ag3", "ag4"]), "start": 10 * k, "end": 10 * k + rng.choice([5, 5, 5, 12]), "single": rng.random() < 0.9} for k in range(rng.randint(0, 9))]
        assert wp.serial_runs(items) == quadratic(items)


def test_quick_re_edits_and_pairs(spark):
    text = "return value + 1  # of the first"
    rows = [{**EDIT, "new": f"x = 1; {text}; y"}, {**EDIT, "old": text, "new": "b" * 30, "at": 600_000}, {**EDIT, "old": text, "at": 600_001, "new": "c"}, {**EDIT, "old": "c", "new": text, "at": 600_002}, {**EDIT, "old": "b" * 30, "agent_id": "a1", "at": 600_003}]
    rows += [{**EDIT, "file": "n.md", "new": text}, {**EDIT, "file": "n.md", "old": text}]
    got = {(r.context, r.file): (r.edits, r.quick, r.backed) for r in wp.edit_churn(calls(spark, rows)).collect()}
    assert got == {("main", "/w/a.py"): (4, 1, 1), ("a1", "/w/a.py"): (1, 0, 0), ("main", "n.md"): (2, 0, 0)}
