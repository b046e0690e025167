"""Patterns in the order of a session's work: edits that are edited again, work taken back, agents run one by one.

``bound_calls`` makes tool calls with inputs out of ``events``: ten users' week is a session, an hour of events a minute.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shell
from ..sources.records import records_from_events
from .session_queries import REC

#: Fixed values of the rules.
CHURN_EDITS, THRASH, ANCHOR_CHARS, QUICK_MS, BACK = 6, 3, 24, 600_000, 20
RITUAL, EARLY_TURNS, RUN, WINDOW, NAME_CHARS = 3, 3, 3, 16, 4
WORKTREE = r"/\.?worktrees?/|/worktree-"
COMMANDS = (
    "npm test", "git revert HEAD", "git restore --staged a.py", "git restore a.py", "git reset --hard origin/main", "git reset --hard", "git checkout main -- a.py", "git checkout -- gen.json", "git checkout HEAD~1 -- b.py",
    "git stash", "echo git revert", "git stash pop", "ls && git stash push", "cd /w/.worktrees/x && git reset --hard main", "git checkout dev", "make build", "git checkout -- gen.json", "git add .; git checkout -f -- gen.json", "pytest -q || git checkout HEAD^ -- c.py d.py",
)
_FIELDS = {
    "tool": "CASE WHEN event_type = 'purchase' AND k % 4 = 1 THEN 'Task' ELSE tool END",
    "at": "CAST(floor(start_ms / 60) AS BIGINT)",
    "cwd": "CASE WHEN workspace % 6 = 5 THEN '/w/worktrees/t' ELSE '/w/p' END",
    "file": "concat('/w/f', k % 3, CASE WHEN k % 7 = 0 THEN '.md' ELSE '.py' END)",
    "old": "CASE WHEN k % 11 = 0 THEN 'value' WHEN k % 13 = 0 THEN '' ELSE concat('def handler_', (ord + k) % 2, '(value): return value + ', k % 2) END",
    "new": "concat(CASE WHEN k % 9 = 0 THEN 'x = 1; ' ELSE '' END, 'def handler_', ord % 2, '(value): return value + ', (ord + k) % 2)",
    "unresolved": "k % 31 = 4",
    "prompt": "concat('Look at  part ', ord % 6, CASE WHEN k % 3 = 0 THEN concat(' and use ', repeat(concat('r', (ord * 7) % 5, '-'), 6)) ELSE '' END, CASE WHEN k % 6 = 1 THEN concat(' with scout', (ord + 1) % 4) ELSE '' END, CASE WHEN k % 10 = 7 THEN concat(' after ag', ord - 2) ELSE '' END)",
    "preview": "CASE WHEN k % 8 = 0 THEN 'r1-r1-' ELSE repeat(concat('r', ord % 5, '-'), 8) END",
    "name": "CASE WHEN k % 5 = 2 THEN concat('scout', ord % 4) WHEN k % 5 = 3 THEN 'Loo' END",
    "spawned": "concat('ag', ord)",
}


def bound_calls(events: DataFrame) -> DataFrame:
    """Tool calls: session_id, ord, turn_index, agent_id, tool, at, duration_ms, is_error, message_id, command, cwd, and inputs and results."""
    rec = records_from_events(events.withColumn("user_id", F.floor(F.col("user_id") / 10).cast("long"))).filter("tool is not null")
    pick = F.pmod(F.col("workspace") * 5 + F.col("k") % 4 + F.col("ord") % 3, F.lit(len(COMMANDS))).cast("int")
    command = F.when(F.col("tool") == "Bash", F.get(F.array(*[F.lit(c) for c in COMMANDS]), pick))
    names = list(_FIELDS)
    rec = rec.withColumns({n: F.expr(sql) for n, sql in _FIELDS.items()}).withColumn("command", command)
    return rec.select("session_id", "ord", "turn_index", "agent_id", "at", "duration_ms", "is_error", "message_id", "command", *[n for n in names if n != "at"])


CALLS = REC.replace("FROM events)", "FROM (SELECT * REPLACE (user_id // 10 AS user_id) FROM events))") + f""",
w AS (SELECT session_id, ord, turn_index, agent_id, duration_ms, is_error, message_id, CASE WHEN tool = 'Bash' THEN [{", ".join("'" + c + "'" for c in COMMANDS)}][(workspace * 5 + k % 4 + ord % 3) % {len(COMMANDS)} + 1] END AS command,
  {", ".join(f"{sql} AS {'ms' if n == 'at' else n}" for n, sql in _FIELDS.items() if n != "tool")}, {_FIELDS["tool"]} AS kind FROM rec WHERE tool IS NOT NULL)"""


def edit_churn(calls: DataFrame) -> DataFrame:
    """Of each session and (context, file): edits, quick re-edits, and edits that put back what the one before took out.

    A quick re-edit changes text that one of the last 20 edits of its context and file wrote within ten minutes: an edit whose old
    text, if it is long enough to say something, is part of what was written. Markdown files do not count; pairs count by file alone.
    """
    edits = calls.filter("tool = 'Edit'")
    by_file = Window.partitionBy("session_id", "file").orderBy("ord")
    cut = lambda c: F.substring(c, 1, 200)
    before = F.lag(F.struct(cut("old").alias("o"), cut("new").alias("n"))).over(by_file)
    back = (F.col("old") != "") & (F.col("new") != "") & (cut("old") == before["n"]) & (cut("new") == before["o"])
    edits = edits.withColumns({"back": F.coalesce(back, F.lit(False)), "context": F.coalesce("agent_id", F.lit("main"))})
    lately = Window.partitionBy("session_id", "context", "file").orderBy("ord").rowsBetween(-BACK, -1)
    written = F.collect_list(F.struct("at", "new")).over(lately)
    quick = (F.length("old") >= ANCHOR_CHARS) & F.exists(written, lambda x: (F.col("at") - x["at"] <= QUICK_MS) & F.contains(x["new"], F.col("old"))) & ~F.col("file").endswith(".md")
    edits = edits.withColumn("quick", quick)
    return edits.groupBy("session_id", "context", "file").agg(F.count("*").alias("edits"), F.count(F.when(F.col("quick"), 1)).alias("quick"), F.count(F.when(F.col("back"), 1)).alias("backed"))


def revert_calls(calls: DataFrame) -> DataFrame:
    """Shell calls that take work back: session_id, ord, turn_index, command, kinds, after_failed_test.

    Not counted: unstaging; a checkout of paths from a named ref; a hard reset to a base branch in a worktree or in the first turns;
    a stash before any edit, in a worktree, or one that the session applies again; a checkout of paths that the session restores three times or more.
    """
    session, before = Window.partitionBy("session_id"), Window.unboundedPreceding
    earlier = session.orderBy("ord").rowsBetween(before, -1)
    rows = calls.withColumn("saw_edit", F.coalesce(F.max(F.col("tool").isin("Edit", "Write")).over(earlier), F.lit(False))).filter("command is not null")
    segs = shell.exploded(rows.select("session_id", "ord", "command"), "command").select("session_id", "ord", "n", "segment", "purpose")
    words = F.split("segment", " ")
    rest = F.slice(words, 3, 1 << 20)
    plain = lambda xs: F.get(F.filter(xs, lambda w: ~w.startswith("-")), F.lit(0))
    dashes = F.array_position(words, "--")
    git = F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1) == "git"
    segs = segs.select(
        "session_id", "ord", "n", "purpose", F.when(git, F.get(words, F.lit(1))).alias("sub"), F.get(words, F.lit(2)).alias("third"), F.array_contains(words, "--staged").alias("staged"), F.array_contains(words, "--hard").alias("hard"),
        plain(rest).alias("target"), dashes.alias("dashes"), plain(F.slice(words, 3, F.greatest(dashes - 3, F.lit(0)).cast("int"))).alias("ref"), F.when(dashes > 0, F.array_join(F.slice(words, dashes.cast("int") + 1, 1 << 20), " ")).alias("paths"),
    )
    s = segs.join(rows, ["session_id", "ord"])
    turn = Window.partitionBy("session_id", "turn_index")
    failed_test = (F.col("purpose") == "test") & F.col("is_error")
    worktree = F.col("cwd").rlike(WORKTREE) | F.col("command").rlike(WORKTREE)
    base = F.col("target").isin("main", "master") | F.coalesce(F.col("target").startswith("origin/"), F.lit(False))
    kind = (
        F.when(F.col("sub") == "revert", "revert").when((F.col("sub") == "restore") & ~F.col("staged"), "restore")
        .when((F.col("sub") == "reset") & F.col("hard") & ~(F.coalesce(base, F.lit(False)) & (worktree | (F.col("turn_index") < EARLY_TURNS))), "reset-hard")
        .when((F.col("sub") == "checkout") & (F.col("dashes") > 0) & (F.col("ref").isNull() | F.col("ref").rlike(r"^HEAD(~\d*|\^+)?$")), "checkout")
        .when((F.col("sub") == "stash") & F.coalesce(F.col("third") == "push", F.lit(True)) & F.col("saw_edit") & ~worktree, "stash")
    )
    s = s.withColumns({"kind": kind, "test_failed_in_turn": F.max(failed_test).over(turn), "applied": F.max((F.col("sub") == "stash") & F.coalesce(F.col("third").isin("pop", "apply"), F.lit(False))).over(session)})
    s = s.withColumns({
        "after_failed_test": F.coalesce(F.max(F.col("is_error") & F.col("test_failed_in_turn")).over(turn.orderBy("ord").rangeBetween(before, -1)), F.lit(False)),
        "restored": F.count(F.when(F.col("kind") == "checkout", 1)).over(Window.partitionBy("session_id", F.when(F.col("kind") == "checkout", F.col("paths")))),
    })
    counts = F.col("kind").isNotNull() & ~((F.col("kind") == "stash") & F.coalesce("applied", F.lit(False))) & ~((F.col("kind") == "checkout") & (F.col("restored") >= RITUAL))
    return s.filter(counts).groupBy("session_id", "ord", "turn_index", "command", "after_failed_test").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


def _folded(text: str | None) -> str:
    return " ".join((text or "").split())


def serial_runs(items: list[dict], least: int = RUN) -> list[list[dict]]:
    """Runs of agent calls of one turn, in order, that ran one after another though none needs one before it.

    ``items``: prompt, preview, name, spawned, start, end, single. A call in company or without a result ends a run. So does one that
    begins before the last one has ended, or whose prompt names an earlier agent of the run or holds ``WINDOW`` characters of its result:
    the windows of the run's results are kept as a set, into which the prompt's are looked up.
    """
    out, run, windows, names = [], [], set(), set()

    def flush() -> None:
        nonlocal run
        if len(run) >= least:
            out.append(run)
        run = []
        windows.clear()
        names.clear()

    for x in items:
        if not x["single"]:
            flush()
            continue
        prompt, preview = _folded(x["prompt"]), _folded(x["preview"])
        overlaps = bool(run) and x["start"] < run[-1]["end"]
        if overlaps or any(n in prompt for n in names) or any(prompt[i : i + WINDOW] in windows for i in range(len(prompt) - WINDOW + 1)):
            flush()
        run.append(x)
        windows.update(preview[i : i + WINDOW] for i in range(len(preview) - WINDOW + 1))
        names.update(n for n in (x["spawned"], x["name"] if len(x["name"] or "") >= NAME_CHARS else None) if n)
    flush()
    return out


def agent_runs(calls: DataFrame) -> DataFrame:
    """session_id, turn_index, first (ord), agents, serial_ms, longest_ms of each run of agents that could have run side by side.

    The calls that start agents are brought together by session and turn; a turn's are few.
    """
    group = Window.partitionBy("session_id", "message_id")
    spawns = calls.withColumn("single", (F.count("*").over(group) == 1) & ~F.col("unresolved")).filter("tool = 'Task' and agent_id is null")
    spawns = spawns.select("session_id", "turn_index", "ord", "prompt", "preview", "name", "spawned", F.col("at").alias("start"), (F.col("at") + F.col("duration_ms")).alias("end"), "duration_ms", "single")
    fields = "session_id string, turn_index int, first long, agents long, serial_ms long, longest_ms long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> list[tuple]:
            found = [(r[0]["session_id"], r[0]["turn_index"], r[0]["ord"], len(r), sum(x["duration_ms"] for x in r), max(x["duration_ms"] for x in r)) for r in serial_runs(held)]
            held.clear()
            return found

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [f.split()[0] for f in fields.split(", ")])

        for b in batches:
            rows = []
            for x in b.to_pylist():
                if held and (held[0]["session_id"], held[0]["turn_index"]) != (x["session_id"], x["turn_index"]):
                    rows += done()
                held.append(x)
            yield batch(rows)
        yield batch(done())

    return spawns.repartition("session_id", "turn_index").sortWithinPartitions("session_id", "turn_index", "ord").mapInArrow(fold, fields)


def work_insights(calls: DataFrame) -> DataFrame:
    """rule, session_id, severity, saving_ms of edit-churn, reverts and fanout-opportunity."""
    e = edit_churn(calls)
    plain = ~F.col("file").endswith(".md")
    churn = e.groupBy("session_id").agg(F.count(F.when(plain & (F.col("edits") >= CHURN_EDITS), 1)).alias("churned"), F.count(F.when(plain & (F.col("quick") >= THRASH), 1)).alias("thrashed"), F.sum("backed").alias("pairs"))
    back = revert_calls(calls).groupBy("session_id").agg(F.count("*").alias("reverts"), F.count(F.when(F.col("after_failed_test"), 1)).alias("after_failed"))
    fan = agent_runs(calls).groupBy("session_id").agg(F.count("*").alias("runs"), F.sum(F.col("serial_ms") - F.col("longest_ms")).alias("saved"))
    f = calls.select("session_id").distinct().join(churn, "session_id", "left").join(back, "session_id", "left").join(fan, "session_id", "left").na.fill(0)
    row = lambda name, fires, severity, saving=F.lit(0): F.struct(F.lit(name).alias("rule"), fires.alias("fires"), severity.cast("int").alias("severity"), saving.cast("long").alias("saving_ms"))
    rows = F.array(
        row("edit-churn", F.col("churned") + F.col("thrashed") > 0, F.when(F.col("thrashed") > 0, 2).otherwise(1)),
        row("reverts", (2 * F.col("pairs") + F.col("reverts") >= 2) | (F.col("after_failed") > 0), F.when(F.col("after_failed") > 0, 2).otherwise(1)),
        row("fanout-opportunity", F.col("runs") > 0, F.lit(1), F.col("saved")),
    )
    return f.select("session_id", F.explode(rows).alias("x")).filter("x.fires").select("x.rule", "session_id", "x.severity", "x.saving_ms")


def _of(f):
    return lambda spark, sf_dir: f(bound_calls(spark.read.parquet(f"{sf_dir}/events.parquet")))


_CHURN = CALLS + f""",
ed AS (SELECT *, coalesce(agent_id, 'main') AS context, row_number() OVER (PARTITION BY session_id, coalesce(agent_id, 'main'), file ORDER BY ord) AS i, lag(old) OVER f AS po, lag(new) OVER f AS pn FROM w WHERE kind = 'Edit' WINDOW f AS (PARTITION BY session_id, file ORDER BY ord)),
qk AS (SELECT DISTINCT a.session_id, a.ord FROM ed a JOIN ed b ON b.session_id = a.session_id AND b.context = a.context AND b.file = a.file AND b.i BETWEEN a.i - {BACK} AND a.i - 1
  WHERE length(a.old) >= {ANCHOR_CHARS} AND a.ms - b.ms <= {QUICK_MS} AND contains(b.new, a.old) AND a.file NOT LIKE '%.md'),
churn AS (SELECT ed.session_id AS session_id, context, file, count(*) AS edits, count(qk.ord) AS quick, count(CASE WHEN old <> '' AND new <> '' AND old = pn AND new = po THEN 1 END) AS backed FROM ed LEFT JOIN qk ON qk.session_id = ed.session_id AND qk.ord = ed.ord GROUP BY ALL)"""
_REVERTS = f""",
cmd AS (SELECT *, EXISTS (FROM w e WHERE e.session_id = w.session_id AND e.kind = 'Edit' AND e.ord < w.ord) AS saw_edit, regexp_matches(cwd, '{WORKTREE}') OR regexp_matches(command, '{WORKTREE}') AS tree FROM w WHERE command IS NOT NULL),
sg AS (SELECT session_id, ord, turn_index, is_error, command, saw_edit, tree, generate_subscripts(p, 1) AS n, string_split(trim(unnest(p)), ' ') AS x FROM (SELECT *, regexp_split_to_array(command, '&&|\\|\\||;') AS p FROM cmd)),
hit AS (SELECT *, array_to_string(x[list_position(x, '--') + 1:], ' ') AS paths, x[1] = 'git' AND x[2] = 'stash' AND coalesce(x[3] IN ('pop', 'apply'), false) AS pops, is_error AND (array_to_string(x, ' ') = 'npm test' OR x[1] = 'pytest') AS failed, CASE WHEN x[1] <> 'git' THEN NULL
  WHEN x[2] = 'revert' THEN 'revert' WHEN x[2] = 'restore' AND NOT list_contains(x, '--staged') THEN 'restore'
  WHEN x[2] = 'reset' AND list_contains(x, '--hard') AND NOT (coalesce(x[4] IN ('main', 'master') OR x[4] LIKE 'origin/%', false) AND (tree OR turn_index < {EARLY_TURNS})) THEN 'reset-hard'
  WHEN x[2] = 'checkout' AND list_contains(x, '--') AND NOT coalesce(x[3] NOT LIKE '-%' AND x[3] NOT LIKE 'HEAD%', false) THEN 'checkout' WHEN x[2] = 'stash' AND coalesce(x[3] = 'push', true) AND saw_edit AND NOT tree THEN 'stash' END AS what FROM sg),
fails AS (SELECT session_id, turn_index, min(ord) AS ord FROM hit WHERE is_error AND (session_id, turn_index) IN (SELECT (session_id, turn_index) FROM hit WHERE failed) GROUP BY ALL),
good AS (SELECT hit.* FROM hit WHERE what IS NOT NULL AND NOT (what = 'stash' AND EXISTS (FROM hit p WHERE p.session_id = hit.session_id AND p.pops)) AND NOT (what = 'checkout' AND (SELECT count(*) FROM hit o WHERE o.session_id = hit.session_id AND o.what = 'checkout' AND o.paths = hit.paths) >= {RITUAL})),
rv AS (SELECT good.session_id AS session_id, good.ord AS ord, good.turn_index AS turn_index, command, coalesce(fails.ord < good.ord, false) AS after_failed_test, string_agg(what, ',' ORDER BY n) AS kinds FROM good LEFT JOIN fails ON fails.session_id = good.session_id AND fails.turn_index = good.turn_index GROUP BY ALL)"""
_RUNS = f""",
grp AS (SELECT session_id, message_id, count(*) AS n FROM w GROUP BY ALL),
sp AS (SELECT w.*, n = 1 AND NOT unresolved AS single, regexp_replace(prompt, '\\s+', ' ', 'g') AS pr, row_number() OVER (PARTITION BY w.session_id, turn_index ORDER BY ord) AS i FROM w JOIN grp USING (session_id, message_id) WHERE kind = 'Task' AND agent_id IS NULL),
dep AS (SELECT a.session_id AS session_id, a.turn_index AS turn_index, a.i AS i, max(b.i) AS j FROM sp a JOIN sp b ON b.session_id = a.session_id AND b.turn_index = a.turn_index AND b.i < a.i
  WHERE (b.i = a.i - 1 AND a.ms < b.ms + b.duration_ms) OR contains(a.pr, b.spawned) OR (length(b.name) >= {NAME_CHARS} AND contains(a.pr, b.name)) OR len(list_filter(range(1, length(b.preview) - {WINDOW} + 2), lambda q: contains(a.pr, substr(b.preview, q, {WINDOW})))) > 0 GROUP BY ALL),
fold AS (WITH RECURSIVE f AS (SELECT session_id, turn_index, i, CASE WHEN single THEN 1 ELSE 2 END AS start FROM sp WHERE i = 1
  UNION ALL SELECT sp.session_id, sp.turn_index, sp.i, CASE WHEN NOT sp.single THEN sp.i + 1 WHEN dep.j >= f.start THEN sp.i ELSE f.start END FROM f JOIN sp ON sp.session_id = f.session_id AND sp.turn_index = f.turn_index AND sp.i = f.i + 1 LEFT JOIN dep ON dep.session_id = sp.session_id AND dep.turn_index = sp.turn_index AND dep.i = sp.i) SELECT * FROM f),
ag AS (SELECT sp.session_id AS session_id, sp.turn_index AS turn_index, min(ord) AS first, count(*) AS agents, sum(duration_ms)::BIGINT AS serial_ms, max(duration_ms) AS longest_ms FROM fold JOIN sp USING (session_id, turn_index, i) WHERE start <= sp.i GROUP BY sp.session_id, sp.turn_index, start HAVING count(*) >= {RUN})"""
QUERIES = {"edit_churn_by_context": _of(edit_churn), "revert_calls": _of(revert_calls), "agent_runs": _of(agent_runs), "work_insights": _of(work_insights)}
ORACLE = {
    "edit_churn_by_context": _CHURN + " SELECT * FROM churn",
    "revert_calls": CALLS + _REVERTS + " SELECT * FROM rv",
    "agent_runs": CALLS + _RUNS + " SELECT * FROM ag",
    "work_insights": _CHURN + _REVERTS + _RUNS + f""",
c AS (SELECT session_id, count(CASE WHEN file NOT LIKE '%.md' AND edits >= {CHURN_EDITS} THEN 1 END) AS churned, count(CASE WHEN file NOT LIKE '%.md' AND quick >= {THRASH} THEN 1 END) AS thrashed, sum(backed)::BIGINT AS pairs FROM churn GROUP BY 1),
r AS (SELECT session_id, count(*) AS n, count(CASE WHEN after_failed_test THEN 1 END) AS red FROM rv GROUP BY 1), s AS (SELECT DISTINCT session_id FROM w)
SELECT 'edit-churn' AS rule, session_id, CASE WHEN thrashed > 0 THEN 2 ELSE 1 END AS severity, 0::BIGINT AS saving_ms FROM c WHERE churned + thrashed > 0
UNION ALL SELECT 'reverts', session_id, CASE WHEN coalesce(red, 0) > 0 THEN 2 ELSE 1 END, 0 FROM s LEFT JOIN c USING (session_id) LEFT JOIN r USING (session_id) WHERE 2 * coalesce(pairs, 0) + coalesce(n, 0) >= 2 OR coalesce(red, 0) > 0
UNION ALL SELECT 'fanout-opportunity', session_id, 1, sum(serial_ms - longest_ms)::BIGINT FROM ag GROUP BY session_id""",
}
