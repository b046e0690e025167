"""Facts of sessions: cases written by hand with what they must give, and what the fixture of the queries must hold."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.plans.fact_queries import ORACLE
from spindrift.sources import session_facts as sf
from spindrift.sources import transcripts as ts

DATA = "/root/testdata/sf0.01"


def records(spark, *lines):
    return records_of(spark, {"s": lines})


def records_of(spark, sessions):
    rows = [(session, n, x if isinstance(x, str) else json.dumps(x)) for session, lines in sessions.items() for n, x in enumerate(lines)]
    return sf.fact_records(spark.createDataFrame(rows, "session string, number long, line string"))


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


def assistant(content, id=None, **more):  # noqa: A002
    usage = more.pop("usage", None)
    return {"type": "assistant", "message": {"id": id, "role": "assistant", "model": more.pop("model", "large-4"), "stop_reason": more.pop("stop", None), "content": content, **({"usage": usage} if usage else {})}, **more}


def attachment(type, side=False, **fields):  # noqa: A002
    return {"type": "attachment", **({"isSidechain": True} if side else {}), "attachment": {"type": type, **fields}}


BORDER = {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto", "preTokens": 9}}
SUMMARY = user("so far", isCompactSummary=True)


def test_turns_count_prompts_of_the_main_thread_only(spark):
    lines = [SUMMARY, user("first"), user("<task-notification>x"), user("part", isSidechain=True, agentId="a"), user("again", isSidechain=True, agentId="a"), user([{"type": "tool_result", "tool_use_id": "c", "content": "x"}]), user("second", uuid="u"), user("second", uuid="u"), "not json", "[1]"]
    got = [(r.ord, r.main_turn, r.turn) for r in records(spark, *lines).orderBy("ord").collect()]
    assert got == [(0, -1, -1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1), (5, 0, 0), (6, 1, 1)]


COMPACTED = [
    ([BORDER, SUMMARY], [("auto", 6)]), ([BORDER, BORDER, SUMMARY], [("auto", None), ("auto", 6)]), ([BORDER, SUMMARY, SUMMARY], [("auto", 6), ("unknown", 6)]), ([SUMMARY, BORDER], [("unknown", 6), ("auto", None)]),
    ([SUMMARY, SUMMARY], [("unknown", 6), ("unknown", 6)]), ([BORDER, user("hello"), SUMMARY], [("auto", 6)]), ([{"type": "system", "subtype": "compact_boundary"}], [("unknown", None)]), ([user("hello")], []),
]


def test_boundaries_pair_with_the_next_summary(spark):
    rows = sf.compactions(records_of(spark, {str(k): lines for k, (lines, _) in enumerate(COMPACTED)})).orderBy("ord").collect()
    assert [[(r.trigger, r.summary_chars) for r in rows if r.session == str(k)] for k in range(len(COMPACTED))] == [want for _, want in COMPACTED]


def test_hook_runs_and_what_is_none(spark):
    run = dict(hookEvent="PreToolUse", command="lint")
    lines = [
        attachment("hook_success", **run, durationMs=5), attachment("hook_success", **run, exitCode=2), attachment("hook_cancelled", **run), attachment("hook_additional_context", **run), attachment("hook_success", hookEvent="Stop"), attachment("hook_success"),
        attachment("async_hook_response", hookEvent="PostToolUse", hookName="fmt", exitCode=0), attachment("hook_success", hookEvent="PostToolUse", command="lint"),
        {"type": "system", "subtype": "stop_hook_summary", "hookInfos": [{"command": "stop", "durationMs": 7}], "hookErrors": [{"command": "stop"}, "bad\n  end"]},
    ]
    rec = records(spark, *lines)
    assert [(r.ord, r.n, r.event, r.command, r.name, r.ok) for r in sf.hook_runs(rec).orderBy("ord", "n").collect()] == [
        (0, 0, "PreToolUse", "lint", None, True), (1, 0, "PreToolUse", "lint", None, False), (2, 0, "PreToolUse", "lint", None, False), (6, 0, "PostToolUse", None, "fmt", True), (7, 0, "PostToolUse", "lint", None, True),
        (8, 0, "Stop", "stop", None, True), (8, 1, "Stop", "stop", None, False), (8, 2, "Stop", "bad end", None, False),
    ]
    by = {r.hook: (r.known_by, r.runs, r.total_ms, r.errors, r.event, r.events) for r in sf.hooks_by_command(sf.hook_runs(rec)).collect()}
    assert by == {"lint": ("command", 4, 5, 2, "PreToolUse", "PostToolUse=1,PreToolUse=3"), "fmt": ("name", 1, 0, 0, "PostToolUse", "PostToolUse=1"), "stop": ("command", 2, 7, 1, "Stop", "Stop=2"), "bad end": ("command", 1, 0, 1, "Stop", "Stop=1")}


def test_attachments_and_listings(spark):
    file = lambda path, content: {"path": path, "content": content}
    lines = [
        attachment("skill_listing", names=["a", "b"]), attachment("skill_listing", names=["z"]), attachment("skill_listing", names=["c"], isInitial=True, skillCount=4), attachment("skill_listing", side=True, names=["q"]),
        attachment("instructions", files=[file("x", "1"), file("x", "1"), file("x", "2"), file("", "3"), {"path": "y"}]), attachment("instructions", side=True, files=[file("w", "1")]), attachment("read_truncation_notice"),
        attachment("deferred_tools_delta", addedNames=["b", "a"], readdedNames=["a"]), attachment("deferred_tools_delta", addedNames=["C"]), {"type": "attachment"},
    ]
    rec = records(spark, *lines)
    assert [tuple(r) for r in sf.listings(rec).collect()] == [("s", 4, "c", 1, "C,a,b", 2, 1)]
    got = {r.type: (r.n, r.main_n, r.bytes > r.main_bytes) for r in sf.attachments(rec).collect()}
    assert got == {"skill_listing": (4, 3, True), "instructions": (2, 1, True), "read_truncation_notice": (1, 1, False), "deferred_tools_delta": (2, 2, False), "unknown": (1, 1, False)}


def test_events_in_one_stream(spark):
    link = {"type": "pr-link", "prNumber": 4, "prUrl": "u/4"}
    lines = [
        user("go"), link, link, {"type": "queue-operation", "operation": "enqueue", "content": " <system-notification>x"}, {"type": "queue-operation", "operation": "dequeue"}, user("[Request interrupted by user]"), {"type": "system", "subtype": "api_retry", "content": "busy"},
        assistant([{"type": "fallback", "from": {"model": "a"}}, {"type": "tool_use", "id": "1", "name": "AskUserQuestion", "input": {}}, {"type": "tool_use", "id": "2", "name": "EnterPlanMode", "input": {}}]), assistant("no", isApiErrorMessage=True, apiErrorStatus=529, error="rate\nlimit"), attachment("plan_mode_exit"),
    ]
    got = [(r.ord, r.turn, r.kind, r.label, r.detail) for r in sf.event_stream(records(spark, *lines)).orderBy(F.col("ord").asc_nulls_last(), "n").collect()]
    assert got == [
        (1, 0, "pr_link", "PR #4", "u/4"), (3, 0, "other", "queued notification", "<system-notification>x"), (5, 0, "interrupt", "Request interrupted by user", None), (6, 0, "api_error", "api_retry", "busy"),
        (7, 0, "model_fallback", "model fallback a → ?", None), (7, 0, "plan_mode", "EnterPlanMode", None), (8, 0, "api_error", "API error 529", "rate limit"), (9, 0, "plan_mode", "plan_mode_exit", None), (None, -1, "permission_prompt", "AskUserQuestion x1", None),
    ]


def test_requests_carry_what_other_parts_say_and_hidden_attempts_of_the_counted_one(spark):
    tries = lambda *types: [{"type": t, "input_tokens": 5, "output_tokens": 1} for t in types]
    use = lambda n: {"type": "tool_use", "id": n, "name": n, "input": {}}
    first = assistant([use("Read")], "m", usage={"output_tokens": 9, "output_tokens_details": {"thinking_tokens": 8}, "iterations": tries("a", "b", "c")})
    first["message"]["diagnostics"] = {"cache_miss_reason": {"cache_missed_input_tokens": 3}}
    lines = [first, assistant([use("Bash")], "m", stop="end_turn", usage={"output_tokens": 4, "output_tokens_details": {"thinking_tokens": 2}, "iterations": tries("fallback_message", "message")}), assistant("x", usage={"output_tokens": 1, "iterations": tries("message")}), assistant("x", "q"), assistant("x", "y", model="<synthetic>", usage={"output_tokens": 1})]
    req = sf.requests(records(spark, *lines))
    assert sorted((r.request, r.tokens, r.miss, r.missed_tokens, r.thinking_tokens, r.category) for r in req.collect()) == [("#2", 1, None, None, None, "no-tool"), ("m", 4, "unknown", 3, 8, "mixed")]
    assert [(r.request, r.n, r.model, r.type, r.tokens) for r in sf.hidden_iterations(req).collect()] == [("m", 0, "large-4", "fallback_message", 6)]


def asked(ms, agent=None):
    ask = assistant([{"type": "tool_use", "id": "c", "name": "AskUserQuestion", "input": {}}], timestamp="2026-01-01T00:00:00Z")
    at = lambda n: 1767225600000 + n
    lines = [ask, user([{"type": "tool_result", "tool_use_id": "c", "content": "yes"}], timestamp=at(ms))]
    return lines + [user("work", isSidechain=True, agentId="a", timestamp=at(t)) for t in agent or ()]


RULES = [
    (asked(300_000), []), (asked(300_001), [("blocking-questions", "low")]), (asked(1_800_001), [("blocking-questions", "medium")]), (asked(7_200_001), [("blocking-questions", "high")]), (asked(7_200_001, (5, 9)), [("blocking-questions", "medium")]),
    (asked(7_200_001, (-9, 0)), [("blocking-questions", "high")]), ([assistant("x", "m", usage={"iterations": [{"type": "a"}, {"type": "b"}]})], [("hidden-iterations", "info")]),
    ([assistant("x", "m", usage={"iterations": [{"type": "a"}, {"type": "b"}]}), {"type": "system", "subtype": "model_refusal_fallback"}], [("hidden-iterations", "high")]),
    ([attachment("deferred_tools_delta", addedNames=[f"mcp__git__{k}" for k in range(20_000)]), assistant("x", "m", usage={"output_tokens": 1})], [("mcp-definition-weight", "info")]),
    ([attachment("deferred_tools_delta", addedNames=[f"mcp__git__{k}" for k in range(19_999)]), assistant("x", "m", usage={"output_tokens": 1})], []),
    ([attachment("deferred_tools_delta", addedNames=[f"mcp__git__{k}" for k in range(20_000)]), assistant([{"type": "tool_use", "id": "c", "name": "mcp__git__0", "input": {}}], "m", usage={"output_tokens": 1})], []),
]


def test_rules_at_their_limits(spark):
    rec = records_of(spark, {str(k): lines for k, (lines, _) in enumerate(RULES)})
    rows = sf.fact_rules(rec, ts.tool_calls(ts.blocks(rec))).collect()
    assert [[(r.rule, r.severity) for r in rows if r.session == str(k)] for k in range(len(RULES))] == [want for _, want in RULES]


PROMPTS = [
    ("hello", {}, "human"), ("<div>pasted</div>", {}, "human"), ("", {}, "human"), ("x [Request Interrupted by user for tool use]", {}, "interrupt"), ("x" * 200 + "[request interrupted by user", {}, "human"), ("<command-name>/go</command-name>", {}, "command"),
    ("<command-message>go</command-message>", {}, "command"), ("<system-reminder>a</system-reminder>\n <system-reminder>b\n</system-reminder> <local-command-stderr>x", {}, "local_output"), ("<system-reminder>open", {}, "meta"), ("<budget:3>", {}, "meta"), ("a", {"isMeta": True}, "meta"),
    ("a", {"isMeta": True, "promptSource": "system"}, "scheduled"), ("<task-notification>", {"isMeta": True}, "notification"), ("<task-notification>", {"promptSource": "typed"}, "human"), ("a <command-name>/b</command-name>", {"origin": {"kind": "human"}}, "command"),
    ("a", {"origin": {"kind": "teammate"}}, "peer"), ("a", {"origin": {"kind": "task-notification"}}, "notification"), ("a", {"isVisibleInTranscriptOnly": True}, "meta"), ("Another Claude session sent a message: x", {}, "peer"), ("[Request interrupted by user]", {"isVisibleInTranscriptOnly": True}, "interrupt"),
]


def test_prompt_kinds(spark):
    got = [r.kind for r in records(spark, *[user(text, **more) for text, more, _ in PROMPTS]).orderBy("ord").collect()]
    assert got == [want for *_, want in PROMPTS]
    plain = spark.createDataFrame([("<teammate-message", None)], "t string, m boolean")
    assert plain.select(tx.prompt_kind(F.col("t"), F.col("m"))).first()[0] == "peer"


def test_an_empty_table_gives_no_rows(spark):
    rec = records(spark, "no record")
    for f in (sf.compactions, sf.hook_runs, sf.attachments, sf.session_meta, sf.turn_flags, sf.listings, sf.queue_operations, sf.event_stream, sf.skill_uses, sf.requests, lambda r: sf.fact_rules(r, ts.tool_calls(ts.blocks(r)))):
        assert f(rec).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_the_fixture_holds_every_case():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    seen = lambda query, what: {r[0] for r in con.sql(f"SELECT DISTINCT {what} FROM ({ORACLE[query]})").fetchall()}
    assert seen("compaction_events", "concat(trigger, summary_chars IS NULL)") >= {"autofalse", "manualfalse", "unknownfalse", "autotrue"}
    assert seen("event_stream", "kind") == {"interrupt", "api_error", "model_fallback", "plan_mode", "scheduled_fire", "away_summary", "pr_link", "permission_prompt", "other"}
    assert seen("fact_rules", "severity") == {"high", "medium", "low", "info"}
    assert seen("hooks_by_command", "known_by") == {"command", "name", "event"} and seen("hook_runs", "ok") == {True, False}
    assert seen("turn_flags", "interrupted") == {True, False} and len(seen("turn_flags", "auto_continuations")) > 1
    assert seen("request_notes", "category") >= {"mixed", "no-tool", "edit", "mcp"} and seen("skills_by_name", "via") >= {"tool", "command"}
