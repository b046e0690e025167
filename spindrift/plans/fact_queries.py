"""Queries on the facts of sessions, and their SQL.

``fact_lines`` adds to the lines of transcripts what compactions, hooks, attachments, queues, agents and retries write.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import session_facts as sf
from ..sources import transcripts as ts
from ..sources.live import live_kinds
from .transcript_queries import line_expressions

_T = "(1704067200 + conv_id * 3600 + turn * 60 + {s}) * 1000"


def _line(template: str, second: int = 45) -> str:
    """SQL of a line from a template with expressions in ``«»``; «T» is a time of the turn."""
    parts = re.split("«(.*?)»", template.replace("«T»", f"«{_T.format(s=second)}»"), flags=re.S)
    return "concat(" + ", ".join(p if k % 2 else f"'{p}'" for k, p in enumerate(parts) if p) + ")"


def _put(template: str, *values: str) -> str:
    """A template with its marks ``%s`` filled in order; other per cent signs are SQL's."""
    pieces = template.split("%s")
    return pieces[0] + "".join(v + rest for v, rest in zip(values, pieces[1:], strict=True))


_USAGE = '"usage":{"input_tokens":«conv_id»,"output_tokens":%s,"cache_read_input_tokens":«turn * 100»,"cache_creation_input_tokens":0'
_TRY = '{"type":"%s","input_tokens":«turn + 1»,"output_tokens":2,"cache_read_input_tokens":10}'


def fact_kinds() -> list[tuple[str, str]]:
    """(condition, line) of each further kind of line; the same words in both engines."""
    border = '{"type":"system","subtype":"compact_boundary","uuid":"%s«conv_id»-«turn»","timestamp":«T»,"content":"compacted","compactMetadata":{"trigger":"«CASE WHEN conv_id % 2 = 0 THEN \'auto\' ELSE \'manual\' END»","preTokens":«150000 + conv_id»«CASE WHEN turn % 8 = 1 THEN \',"postTokens":9000,"durationMs":1200,"cumulativeDroppedTokens":140000\' ELSE \'\' END»}}'
    summary = '{"type":"user","uuid":"%s«conv_id»-«turn»","timestamp":«T»,"isCompactSummary":true,"message":{"role":"user","content":"This session goes on from «turn * 7» earlier steps"}}'
    hook = '{"type":"attachment","timestamp":«T»«CASE WHEN conv_id % 9 = 3 THEN \',"isSidechain":true\' ELSE \'\' END»,"attachment":{"type":"«CASE (conv_id + turn) % 7 WHEN 0 THEN \'hook_error\' WHEN 1 THEN \'hook_cancelled\' WHEN 2 THEN \'async_hook_response\' WHEN 3 THEN \'hook_additional_context\' WHEN 4 THEN \'hook_non_blocking_error\' ELSE \'hook_success\' END»","hookEvent":"«CASE turn % 5 WHEN 1 THEN \'PreToolUse\' WHEN 3 THEN \'Stop\' ELSE \'PostToolUse\' END»"«CASE WHEN conv_id % 2 = 0 THEN concat(\',"command":"lint.sh","durationMs":\', turn * 10) WHEN conv_id % 4 = 1 THEN \',"hookName":"fmt"\' ELSE \'\' END»«CASE WHEN (conv_id + turn) % 5 = 0 THEN \',"exitCode":1\' WHEN (conv_id + turn) % 5 = 1 THEN \',"exitCode":0\' ELSE \'\' END»}}'
    stop = '{"type":"system","subtype":"stop_hook_summary","uuid":"h«conv_id»-«turn»","timestamp":«T»,"hookInfos":[{"command":"stop.sh","durationMs":«50 + turn»},{"command":"lint.sh"}],"hookErrors":[«CASE WHEN turn % 4 = 1 THEN \'{"command":"stop.sh"}\' ELSE \'"exit   status 2"\' END»]}'
    attach = '{"type":"attachment","timestamp":«T»«CASE WHEN conv_id % 6 = 5 THEN \',"isSidechain":true\' ELSE \'\' END»,"attachment":{"type":"%s"%s}}'
    part = '{"type":"assistant","uuid":"%s«conv_id»-«turn»","timestamp":«T»,"effort":"«CASE WHEN turn % 4 = 1 THEN \'high\' ELSE \'low\' END»","message":{"id":"i«conv_id»-«turn»","role":"assistant","model":"large-4",%s"content":[%s],%s}}'
    one = _put(part, "i", '"diagnostics":{"cache_miss_reason":{"type":"«CASE WHEN turn % 4 = 1 THEN \'expired\' ELSE \'changed\' END»","cache_missed_input_tokens":«turn * 9»}},', '{"type":"fallback","from":{"model":"large-4"},"to":{"model":"small-4"}},{"type":"tool_use","id":"w«conv_id»-«turn»","name":"Skill","input":{"«CASE WHEN conv_id % 2 = 0 THEN \'skill\' ELSE \'name\' END»":"tidy"}}', _put(_USAGE, "1") + ',"output_tokens_details":{"thinking_tokens":70},"iterations":[' + ",".join([_put(_TRY, "message")] * 3) + "]}")
    two = _put(part, "j", '"stop_reason":"tool_use",', '{"type":"tool_use","id":"v«conv_id»-«turn»","name":"«CASE WHEN turn % 4 = 1 THEN \'ExitPlanMode\' ELSE \'Skill\' END»","input":{"skill":"review"}}', _put(_USAGE, "40") + ',"output_tokens_details":{"thinking_tokens":30},"iterations":[' + _put(_TRY, "«CASE WHEN conv_id % 3 = 0 THEN 'fallback_message' ELSE 'message' END»") + "," + _put(_TRY, "message") + "]}")
    agent = '{"type":"user","uuid":"%s«conv_id»-«turn»","timestamp":«T»,"isSidechain":true,"agentId":"ag«conv_id % 3»","message":{"role":"user","content":"%s"}}'
    ask = '{"type":"assistant","uuid":"o«conv_id»-«turn»","timestamp":«T»,"message":{"id":"o«conv_id»-«turn»","role":"assistant","model":"large-4","content":[{"type":"tool_use","id":"o«conv_id»-«turn»","name":"AskUserQuestion","input":{}}]}}'
    answer = '{"type":"user","uuid":"p«conv_id»-«turn»","timestamp":«' + _T.format(s="48 + (conv_id % 10) * 1000") + '»,"message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"o«conv_id»-«turn»","content":"yes"}]}}'
    sub = '{"type":"system","subtype":"«CASE WHEN turn % 4 = 1 THEN \'scheduled_task_fire\' ELSE \'away_summary\' END»","uuid":"s«conv_id»-«turn»","timestamp":«T»,"version":"2.«turn % 3»","entrypoint":"cli","content":"What   went on, «turn»"«CASE WHEN conv_id % 2 = 0 THEN \',"cronKind":"nightly"\' ELSE \'\' END»}'
    failed = '{"type":"assistant","uuid":"f«conv_id»-«turn»","timestamp":«T»,"isApiErrorMessage":true,"apiErrorStatus":529,"message":{"id":"f«conv_id»-«turn»","role":"assistant","model":"<synthetic>","content":[{"type":"text","text":"API  Error"}]}}'
    told = '{"type":"user","uuid":"w«conv_id»-«turn»","timestamp":«T»,"message":{"role":"user","content":"«CASE WHEN turn % 4 = 0 THEN \'<system-reminder>as it is</system-reminder> <local-command-stdout>ok</local-command-stdout>\' ELSE \'<task-notification>done</task-notification>\' END»"}}'
    files = ',"files":[{"path":"/p/RULES.md","type":"Project","content":"v«turn % 2»"},{"path":"/p/NOTES.md","content":"same"},{"type":"User","content":"no path"},{"path":"/p/EMPTY.md"}]'
    tools = ',"addedNames":["mcp__git__a","mcp__git__b","mcp__git__c","mcp__git__d","mcp__git__e","mcp__db__query"],"readdedNames":["Zed","mcp__git__«turn»"]'
    queue = '{"type":"queue-operation","timestamp":«T»,"operation":"«CASE WHEN turn % 3 = 1 THEN \'dequeue\' ELSE \'enqueue\' END»","content":"«CASE WHEN conv_id % 8 = 3 THEN \'  <task-notification>x\' ELSE concat(\'please   also do \', turn) END»"}'
    busy = "role = 'assistant' AND "
    return [
        (busy + "conv_id % 5 = 1 AND turn % 4 = 1", _line(_put(border, "kb"), 43)), (busy + "conv_id % 15 = 6 AND turn % 4 = 1", _line(_put(border, "kc"), 44)), (busy + "conv_id % 5 = 1 AND turn % 4 = 1 AND conv_id % 10 <> 6", _line(_put(summary, "ks"), 45)), ("role = 'user' AND conv_id % 7 IN (2, 6) AND turn = 2", _line(_put(summary, "kt"), 46)),
        (busy + "conv_id % 3 = 0", _line(hook)), (busy + "conv_id % 6 = 2", _line(stop)),
        ("turn = 0 AND conv_id % 4 = 1", _line(_put(attach, "skill_listing", ',"names":["a","b"],"skillCount":3'))), ("turn = 2 AND conv_id % 8 = 1", _line(_put(attach, "skill_listing", ',"names":["c"],"isInitial":true'))), ("turn = 3 AND conv_id % 4 IN (1, 2)", _line(_put(attach, "skill_listing", ',"names":["d"]'))),
        ("turn <= 2 AND conv_id % 2 = 1", _line(_put(attach, "instructions", files))), (busy + "conv_id % 5 = 2", _line(_put(attach, "read_truncation_notice", ""))), ("turn = 0 AND conv_id % 2 = 0", _line(_put(attach, "deferred_tools_delta", tools))),
        (busy + "conv_id % 6 = 5", _line(_put(attach, "«CASE turn % 3 WHEN 0 THEN 'queued_command' WHEN 1 THEN 'plan_mode_exit' ELSE 'ultra_effort_enter' END»", ',"commandMode":"prompt"'))), ("conv_id % 4 = 3", _line(queue)),
        ("conv_id % 3 = 1", _line('{"type":"permission-mode","permissionMode":"«CASE WHEN turn % 2 = 0 THEN \'default\' ELSE \'plan\' END»"}')), ("turn = 0 AND conv_id % 12 = 7", "'{\"type\":\"worktree-state\"}'"), ("turn = 1 AND conv_id % 14 = 4", _line('{"type":"frame-link","timestamp":«T»,"path":"/p/f«conv_id»"}')),
        (busy + "conv_id % 13 = 6", _line(sub)), ("conv_id % 10 = 8", _line('{"type":"pr-link","timestamp":«T»,"prNumber":«turn % 2»,"prUrl":"https://host/q/«turn % 2»"}')),
        (busy + "conv_id % 7 = 4", _line(one, 46)), (busy + "conv_id % 7 = 4", _line(two, 47)), (busy + "conv_id % 6 = 3", _line(failed)), ("turn = 1 AND conv_id % 11 = 4", _line('{"type":"system","subtype":"model_refusal_fallback","uuid":"z«conv_id»","timestamp":«T»}')),
        (busy + "conv_id % 8 = 6", _line(_put(agent, "ga", "Do the part"), 47)), (busy + "conv_id % 8 = 6 AND turn % 4 = 1", _line(_put(agent, "gb", "[Request interrupted by user for tool use]"), 49)),
        (busy + "turn = 1 AND conv_id % 10 IN (0, 1, 6, 7, 8, 9)", _line(ask, 47)), (busy + "turn = 1 AND conv_id % 10 IN (0, 1, 6, 7, 8)", _line(answer)), ("role = 'user' AND turn > 0 AND conv_id % 9 = 1", _line(told)),
    ]


def fact_lines(conversations: DataFrame) -> DataFrame:
    """session, number, line, in the order of writing."""
    q = "substr(to_json(named_struct('a', coalesce(text, ''))), 6, length(to_json(named_struct('a', coalesce(text, '')))) - 6)"
    lines = F.array(*[F.expr(f"CASE WHEN {cond} THEN {line} END") for cond, line in [*line_expressions(q), *live_kinds(), *fact_kinds()]])
    rows = conversations.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode(lines).alias("n", "line")).filter("line is not null and line <> ''")
    return rows.select(F.concat(F.lit("s"), "conv_id").alias("session"), (F.col("turn") * 100 + F.col("n")).cast("long").alias("number"), "line")


def _of(f):
    return lambda spark, sf_dir: f(sf.fact_records(fact_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _calls(rec: DataFrame) -> DataFrame:
    return ts.tool_calls(ts.blocks(rec))


QUERIES = {
    "compaction_events": _of(sf.compactions),
    "hook_runs": _of(sf.hook_runs),
    "hooks_by_command": _of(lambda rec: sf.hooks_by_command(sf.hook_runs(rec))),
    "attachment_counts": _of(sf.attachments),
    "session_meta": _of(sf.session_meta),
    "turn_flags": _of(sf.turn_flags),
    "session_listings": _of(sf.listings),
    "queue_operations": _of(sf.queue_operations),
    "event_stream": _of(sf.event_stream),
    "skills_by_name": _of(sf.skill_uses),
    "request_notes": _of(lambda rec: sf.requests(rec).drop("iterations")),
    "hidden_iterations": _of(lambda rec: sf.hidden_iterations(sf.requests(rec))),
    "tokens_by_category": _of(lambda rec: sf.tokens_by_category(sf.requests(rec))),
    "definition_weight": _of(lambda rec: sf.definition_weight(rec, _calls(rec), sf.requests(rec))),
    "fact_rules": _of(lambda rec: sf.fact_rules(rec, _calls(rec))),
}

_PARTS = ", ".join(f"CASE WHEN {cond} THEN {line} END" for cond, line in [*line_expressions("to_json(coalesce(text, ''))"), *live_kinds(), *fact_kinds()])
_FOLD = "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format
REC = f"""
WITH k0 AS (SELECT concat('s', conv_id) AS session, turn * 100 + generate_subscripts(x, 1) - 1 AS ord, unnest(x) AS line FROM (SELECT conv_id, turn, [{_PARTS}] AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
k1 AS (SELECT session, ord, line::JSON AS j FROM k0 WHERE starts_with(line, '{{') AND coalesce(json_valid(line), false)),
k2 AS (SELECT session, ord, j, j->>'$.type' AS type, j->>'$.subtype' AS sub, (CASE WHEN t <= 1e12 THEN t * 1000 ELSE t END)::BIGINT AS ms, j->>'$.agentId' AS agent, coalesce((j->>'$.isSidechain')::BOOLEAN, false) AS side, coalesce((j->>'$.isCompactSummary')::BOOLEAN, false) AS summary,
  j->'$.attachment' AS a, j->>'$.attachment.type' AS att, j->'$.message.content' AS c, CASE WHEN json_type(j->'$.message.content') = 'ARRAY' THEN (j->'$.message.content')::JSON[] ELSE [] END AS bs FROM (SELECT *, TRY_CAST(j->>'$.timestamp' AS DOUBLE) AS t FROM k1)
  QUALIFY type NOT IN ('user', 'assistant', 'system') OR j->>'$.uuid' IS NULL OR row_number() OVER (PARTITION BY session, type IN ('user', 'assistant', 'system'), j->>'$.uuid' ORDER BY ord) = 1),
k3 AS (SELECT *, coalesce(CASE WHEN type = 'system' THEN j->>'$.content' WHEN json_type(c) = 'ARRAY' THEN array_to_string(list_transform(list_filter(bs, lambda b: b->>'$.type' = 'text'), lambda b: b->>'$.text'), chr(10)) ELSE c->>'$' END, '') AS text FROM k2),
k4 AS (SELECT *, CASE WHEN type = 'user' AND NOT summary AND c IS NOT NULL AND len(list_filter(bs, lambda b: b->>'$.type' = 'tool_result')) = 0 THEN CASE WHEN contains(text[:200], '[Request interrupted by user') THEN 'interrupt' WHEN text LIKE '<command-name>%' THEN 'command'
  WHEN text LIKE '%<local-command-stdout>%' THEN 'local_output' WHEN text LIKE '<task-notification>%' THEN 'notification' ELSE 'human' END END AS kind FROM k3),
rec AS (SELECT *, CASE WHEN agent IS NULL THEN main_turn ELSE greatest(own - 1, 0) END AS turn FROM (SELECT *, count(CASE WHEN kind IN ('human', 'command') AND NOT side THEN 1 END) OVER (PARTITION BY session ORDER BY ord) - 1 AS main_turn,
  count(CASE WHEN kind IN ('human', 'command') AND side AND agent IS NOT NULL THEN 1 END) OVER (PARTITION BY session, agent ORDER BY ord) AS own FROM k4)),
"""
_RUNS = REC + f"""hr AS (SELECT session, ord, 0 AS n, main_turn AS turn, a->>'$.hookEvent' AS event, a->>'$.hookName' AS name, a->>'$.command' AS command, (a->>'$.durationMs')::BIGINT AS duration_ms, att IN ('hook_success', 'async_hook_response') AND coalesce((a->>'$.exitCode')::BIGINT, 0) = 0 AS ok
  FROM rec WHERE att IN ('hook_success', 'hook_error', 'hook_cancelled', 'async_hook_response', 'hook_non_blocking_error') AND a->>'$.hookEvent' <> 'Stop'
 UNION ALL SELECT session, ord, i - 1, turn, 'Stop', NULL, h->>'$.command', (h->>'$.durationMs')::BIGINT, true FROM (SELECT *, generate_subscripts(hs, 1) AS i, unnest(hs) AS h FROM (SELECT *, (j->'$.hookInfos')::JSON[] AS hs FROM rec WHERE sub = 'stop_hook_summary'))
 UNION ALL SELECT session, ord, 2, turn, 'Stop', NULL, coalesce(j->>'$.hookErrors[0].command', {_FOLD("j->>'$.hookErrors[0]'")}), NULL, false FROM rec WHERE sub = 'stop_hook_summary')
"""
_REQ = REC + """p AS (SELECT *, coalesce(j->>'$.message.id', concat('#', ord)) AS request, j->'$.message.usage' AS u FROM rec WHERE type = 'assistant' AND coalesce(j->>'$.message.model', '') <> '<synthetic>'),
pt AS (SELECT *, (u->>'$.output_tokens')::BIGINT AS out, coalesce((u->>'$.input_tokens')::BIGINT, 0) + coalesce((u->>'$.output_tokens')::BIGINT, 0) + coalesce((u->>'$.cache_read_input_tokens')::BIGINT, 0) + coalesce((u->>'$.cache_creation_input_tokens')::BIGINT, 0) AS tokens FROM p),
best AS (SELECT * FROM pt WHERE u IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, request ORDER BY (j->>'$.message.stop_reason') IS NOT NULL DESC, out DESC, ord DESC) = 1),
more AS (SELECT session, request, arg_min(j->'$.message.diagnostics.cache_miss_reason', CASE WHEN (j->'$.message.diagnostics.cache_miss_reason') IS NOT NULL THEN ord END) AS m, max((u->>'$.output_tokens_details.thinking_tokens')::BIGINT) AS thinking_tokens FROM p GROUP BY ALL),
uses AS (SELECT session, request, count(*) AS c, any_value(CASE WHEN n LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' ELSE CASE n WHEN 'Read' THEN 'read' WHEN 'Bash' THEN 'shell' WHEN 'Edit' THEN 'edit' WHEN 'Grep' THEN 'search' WHEN 'Task' THEN 'agent' WHEN 'Skill' THEN 'skill' WHEN 'ExitPlanMode' THEN 'plan' WHEN 'AskUserQuestion' THEN 'ask' ELSE 'other' END END) AS cat
  FROM (SELECT session, request, b->>'$.name' AS n FROM (SELECT session, request, unnest(bs) AS b FROM p) WHERE b->>'$.type' = 'tool_use') GROUP BY ALL),
req AS (SELECT session, request, best.ord AS ord, best.turn AS turn, best.agent AS agent_id, j->>'$.message.model' AS model, tokens, m->>'$.type' AS miss, (m->>'$.cache_missed_input_tokens')::BIGINT AS missed_tokens, thinking_tokens,
  CASE WHEN uses.c IS NULL THEN 'no-tool' WHEN uses.c = 1 THEN cat ELSE 'mixed' END AS category, u FROM best JOIN more USING (session, request) LEFT JOIN uses USING (session, request)),
hid AS (SELECT session, request, i - 1 AS n, turn, model, x->>'$.type' AS type, (x->>'$.input_tokens')::BIGINT + (x->>'$.output_tokens')::BIGINT + (x->>'$.cache_read_input_tokens')::BIGINT AS tokens
  FROM (SELECT *, generate_subscripts(xs, 1) AS i, unnest(xs) AS x, len(xs) AS most FROM (SELECT *, (u->'$.iterations')::JSON[] AS xs FROM req WHERE (u->'$.iterations') IS NOT NULL)) WHERE i < most)
"""
_WEIGHT = _REQ + """, roster AS (SELECT DISTINCT session, unnest(((a->'$.addedNames')::VARCHAR[]) || ((a->'$.readdedNames')::VARCHAR[])) AS tool FROM rec WHERE att = 'deferred_tools_delta'),
dbs AS (SELECT DISTINCT session FROM (SELECT session, unnest(bs) AS b FROM rec) WHERE b->>'$.name' LIKE 'mcp\\_\\_git%' ESCAPE '\\'),
w AS (SELECT session, 1::BIGINT AS idle_servers, count(*) AS idle_tools FROM roster WHERE tool LIKE 'mcp\\_\\_git\\_\\_%' ESCAPE '\\' AND session NOT IN (FROM dbs) GROUP BY 1 HAVING count(*) >= 5),
wt AS (SELECT w.*, r.n AS main_requests, idle_tools * 25 * r.n AS carried_tokens FROM w JOIN (SELECT session, count(*) AS n FROM req WHERE agent_id IS NULL GROUP BY 1) r USING (session))
"""
ORACLE = {
    "compaction_events": REC + """x AS (SELECT *, lag(summary) OVER w AS after, lead(summary) OVER w AS before, lead(length(text)) OVER w AS next FROM rec WHERE summary OR sub = 'compact_boundary' WINDOW w AS (PARTITION BY session ORDER BY ord))
SELECT session, ord, turn, ms, coalesce(j->>'$.compactMetadata.trigger', 'unknown') AS trigger, (j->>'$.compactMetadata.preTokens')::BIGINT AS context_before, (j->>'$.compactMetadata.postTokens')::BIGINT AS context_after, (j->>'$.compactMetadata.durationMs')::BIGINT AS duration_ms,
 (j->>'$.compactMetadata.cumulativeDroppedTokens')::BIGINT AS dropped_tokens, CASE WHEN summary THEN length(text) WHEN before THEN next END AS summary_chars FROM x WHERE NOT (summary AND after IS NOT DISTINCT FROM false)""",
    "hook_runs": _RUNS + "SELECT * FROM hr",
    "hooks_by_command": _RUNS + """, e AS (SELECT session, coalesce(command, name, event) AS hook, CASE WHEN command IS NOT NULL THEN 'command' WHEN name IS NOT NULL THEN 'name' ELSE 'event' END AS known_by, event, count(*) AS n, coalesce(sum(duration_ms), 0)::BIGINT AS ms, count(CASE WHEN NOT ok THEN 1 END) AS bad FROM hr GROUP BY ALL)
SELECT session, hook, known_by, sum(n)::BIGINT AS runs, sum(ms)::BIGINT AS total_ms, sum(bad)::BIGINT AS errors, first(event ORDER BY n DESC, event) AS event, string_agg(concat(event, '=', n), ',' ORDER BY event) AS events FROM e GROUP BY ALL""",
    "attachment_counts": REC + """x AS (SELECT session, att AS type, NOT side AS main, strlen(a::VARCHAR) AS b FROM rec WHERE type = 'attachment')
SELECT session, type, count(*) AS n, sum(b)::BIGINT AS bytes, count(CASE WHEN main THEN 1 END) AS main_n, coalesce(sum(CASE WHEN main THEN b END), 0)::BIGINT AS main_bytes FROM x GROUP BY ALL""",
    "session_meta": REC + """v AS (SELECT session, ord, what, CASE what WHEN 'branches' THEN j->>'$.gitBranch' WHEN 'versions' THEN j->>'$.version' WHEN 'entrypoints' THEN j->>'$.entrypoint' WHEN 'modes' THEN CASE WHEN type = 'permission-mode' THEN j->>'$.permissionMode' END WHEN 'efforts' THEN j->>'$.effort' ELSE j->>'$.message.model' END AS v
  FROM rec, (SELECT unnest(['branches', 'versions', 'entrypoints', 'modes', 'efforts', 'models']) AS what)),
s AS (SELECT session, what, string_agg(v, ',' ORDER BY o) AS l FROM (SELECT session, what, v, min(ord) AS o FROM v WHERE v IS NOT NULL AND v <> '<synthetic>' GROUP BY ALL) GROUP BY ALL),
p AS (SELECT session, """ + ", ".join(f"max(CASE WHEN what = '{w}' THEN l END) AS {w}" for w in ("branches", "versions", "entrypoints", "modes", "efforts", "models")) + """ FROM s GROUP BY 1),
m AS (SELECT session, arg_min(j->>'$.cwd', CASE WHEN j->>'$.cwd' IS NOT NULL THEN ord END) AS cwd, min(ms) AS first_ms, max(ms) AS last_ms, max(ms) - min(ms) AS wall_ms, bool_or(type = 'worktree-state') AS worktree FROM rec GROUP BY 1)
SELECT m.*, """ + ", ".join(f"coalesce({w}, '') AS {w}" for w in ("branches", "versions", "entrypoints", "modes", "efforts", "models")) + " FROM m LEFT JOIN p USING (session)",
    "turn_flags": REC + """x AS (SELECT * FROM rec WHERE main_turn >= 0)
SELECT session, main_turn AS turn, count(CASE WHEN NOT side AND kind IN ('notification', 'local_output') THEN 1 END) AS auto_continuations, bool_or(agent IS NULL AND type IN ('user', 'assistant', 'system') AND contains(text, '[Request interrupted by user')) AS interrupted,
 arg_max((j->>'$.durationMs')::BIGINT, CASE WHEN sub = 'turn_duration' AND j->>'$.durationMs' IS NOT NULL THEN ord END) AS reported_ms FROM x GROUP BY ALL""",
    "session_listings": REC + """x AS (SELECT * FROM rec WHERE type = 'attachment'),
k AS (SELECT session, a FROM x WHERE att = 'skill_listing' QUALIFY row_number() OVER (PARTITION BY session ORDER BY coalesce((a->>'$.isInitial')::BOOLEAN, false) DESC, CASE WHEN (a->>'$.isInitial')::BOOLEAN THEN -ord ELSE ord END) = 1),
d AS (SELECT session, string_agg(t, ',' ORDER BY t) AS deferred_tools FROM (SELECT DISTINCT session, unnest(((a->'$.addedNames')::VARCHAR[]) || ((a->'$.readdedNames')::VARCHAR[])) AS t FROM x WHERE att = 'deferred_tools_delta') GROUP BY 1),
f AS (SELECT session, count(DISTINCT (f->>'$.path', f->>'$.content')) AS n, count(DISTINCT f->>'$.path') AS np FROM (SELECT session, unnest((a->'$.files')::JSON[]) AS f FROM x WHERE att = 'instructions' AND NOT side) WHERE f->>'$.path' IS NOT NULL AND f->>'$.content' IS NOT NULL GROUP BY 1)
SELECT s.session AS session, coalesce((k.a->>'$.skillCount')::BIGINT, json_array_length(k.a->'$.names')::BIGINT) AS skills, array_to_string((k.a->'$.names')::VARCHAR[], ',') AS skill_names, truncated_reads, coalesce(deferred_tools, '') AS deferred_tools, coalesce(n, 0) AS instruction_files, coalesce(np, 0) AS instruction_paths
FROM (SELECT session, count(CASE WHEN att = 'read_truncation_notice' THEN 1 END) AS truncated_reads FROM x GROUP BY 1) s LEFT JOIN k USING (session) LEFT JOIN d USING (session) LEFT JOIN f USING (session)""",
    "queue_operations": REC + """x AS (SELECT session, j->>'$.operation' AS operation, ltrim(j->>'$.content') LIKE '<task-notification>%' AS told FROM rec WHERE type = 'queue-operation')
SELECT session, operation, count(*) AS n, count(CASE WHEN operation = 'enqueue' AND NOT told THEN 1 END) AS human, count(CASE WHEN operation = 'enqueue' AND told THEN 1 END) AS notification FROM x GROUP BY ALL""",
    "event_stream": REC + f"""ev AS (
 SELECT session, ord, 0 AS n, ms, main_turn AS turn, 'other' AS kind, 'frame link' AS label, j->>'$.path' AS detail FROM rec WHERE type = 'frame-link'
 UNION ALL SELECT session, ord, 0, ms, main_turn, 'other', 'queued command', a->>'$.commandMode' FROM rec WHERE att = 'queued_command'
 UNION ALL SELECT session, ord, 0, ms, main_turn, CASE att WHEN 'plan_mode_exit' THEN 'plan_mode' ELSE 'other' END, att, NULL FROM rec WHERE att IN ('plan_mode_exit', 'ultra_effort_enter')
 UNION ALL SELECT session, ord, 0, ms, main_turn, 'other', CASE WHEN ltrim(j->>'$.content') LIKE '<task-notification>%' THEN 'queued notification' ELSE 'queued message' END, {_FOLD("j->>'$.content'")} FROM rec WHERE type = 'queue-operation' AND j->>'$.operation' = 'enqueue'
 UNION ALL (SELECT session, ord, 0, ms, main_turn, 'pr_link', concat('PR #', coalesce(j->>'$.prNumber', j->>'$.prUrl')), j->>'$.prUrl' FROM rec WHERE type = 'pr-link' QUALIFY row_number() OVER (PARTITION BY session, coalesce(j->>'$.prNumber', j->>'$.prUrl') ORDER BY ord) = 1)
 UNION ALL SELECT session, ord, 0, ms, turn, 'interrupt', 'Request interrupted by user', NULL FROM rec WHERE type = 'user' AND contains(text, '[Request interrupted by user')
 UNION ALL SELECT session, ord, 0, ms, turn, 'model_fallback', 'model fallback large-4 → small-4', NULL FROM rec WHERE type = 'assistant' AND len(list_filter(bs, lambda b: b->>'$.type' = 'fallback')) > 0
 UNION ALL SELECT session, ord, 0, ms, turn, 'plan_mode', 'ExitPlanMode', NULL FROM rec WHERE type = 'assistant' AND len(list_filter(bs, lambda b: b->>'$.name' = 'ExitPlanMode')) > 0
 UNION ALL SELECT session, ord, 0, ms, turn, 'api_error', concat('API error', ' ' || (j->>'$.apiErrorStatus')), {_FOLD("text")} FROM rec WHERE type = 'assistant' AND (j->>'$.isApiErrorMessage')::BOOLEAN
 UNION ALL SELECT session, ord, i, ms, turn, 'api_error', CASE i WHEN 0 THEN 'API error' ELSE sub END, '' FROM rec, (SELECT unnest([0, 1]) AS i) WHERE sub IN ('api_error', 'api_retry')
 UNION ALL SELECT session, ord, 0, ms, turn, CASE sub WHEN 'away_summary' THEN sub ELSE 'scheduled_fire' END, CASE sub WHEN 'away_summary' THEN 'away summary' ELSE coalesce(j->>'$.cronKind', 'scheduled') END, {_FOLD("text")} FROM rec WHERE sub IN ('away_summary', 'scheduled_task_fire')
 UNION ALL SELECT session, NULL, 0, NULL, -1, 'permission_prompt', concat('AskUserQuestion x', count(*)), NULL FROM (SELECT session, unnest(bs) AS b FROM rec WHERE type = 'assistant') WHERE b->>'$.name' = 'AskUserQuestion' GROUP BY 1)
SELECT * FROM ev""",
    "skills_by_name": REC + """x AS (SELECT session, ord, 0 AS i, regexp_extract(text, '<command-name>([^<]+)<', 1) AS skill, 'command' AS via, main_turn AS turn FROM rec WHERE kind = 'command' AND NOT side
 UNION ALL SELECT session, ord, i, coalesce(b->>'$.input.skill', b->>'$.input.name'), 'tool', turn FROM (SELECT session, ord, turn, generate_subscripts(bs, 1) AS i, unnest(bs) AS b FROM rec WHERE type = 'assistant') WHERE b->>'$.name' = 'Skill')
SELECT session, skill, (SELECT count(*) FROM x y WHERE y.session = v.session AND y.skill = v.skill) AS uses, via, turns FROM
 (SELECT session, skill, string_agg(via, ',' ORDER BY o) AS via FROM (SELECT session, skill, via, min((ord, i)) AS o FROM x GROUP BY ALL) GROUP BY ALL) v JOIN (SELECT session, skill, string_agg(turn, ',' ORDER BY o) AS turns FROM (SELECT session, skill, turn, min((ord, i)) AS o FROM x GROUP BY ALL) GROUP BY ALL) t USING (session, skill)""",
    "request_notes": _REQ + "SELECT * EXCLUDE (u) FROM req",
    "hidden_iterations": _REQ + "SELECT session, request, n, turn, model, type, tokens FROM hid",
    "tokens_by_category": _REQ + "SELECT session, category, count(*) AS requests, sum(tokens)::BIGINT AS tokens FROM req GROUP BY ALL",
    "definition_weight": _WEIGHT + "SELECT * FROM wt",
    "fact_rules": _WEIGHT + """, ag AS (SELECT session, agent, min(ms) AS s, max(ms) AS e FROM rec WHERE agent IS NOT NULL AND ms IS NOT NULL GROUP BY ALL),
aq AS (SELECT q.session AS session, q.s AS s, r.e AS e, EXISTS (FROM ag WHERE ag.session = q.session AND ag.s < r.e AND ag.e > q.s) AS worked FROM (SELECT session, ms AS s, b->>'$.id' AS id FROM (SELECT session, ms, unnest(bs) AS b FROM rec) WHERE b->>'$.name' = 'AskUserQuestion') q
 JOIN (SELECT session, arg_max(ms, ord) AS e, b->>'$.tool_use_id' AS id FROM (SELECT session, ord, ms, unnest(bs) AS b FROM rec) WHERE b->>'$.type' = 'tool_result' GROUP BY ALL) r USING (session, id) WHERE r.e - q.s > 300000)
SELECT session, 'hidden-iterations' AS rule, CASE WHEN session IN (SELECT session FROM rec WHERE sub = 'model_refusal_fallback') THEN 'high' WHEN bool_or(type = 'fallback_message') THEN 'medium' ELSE 'info' END AS severity, count(*) AS n, sum(tokens)::BIGINT AS tokens, NULL::BIGINT AS saving_ms FROM hid GROUP BY session
UNION ALL SELECT session, 'blocking-questions', CASE WHEN bool_or(e - s > 7200000 AND NOT worked) THEN 'high' WHEN max(e - s) > 1800000 THEN 'medium' ELSE 'low' END, count(*), NULL, sum(e - s)::BIGINT FROM aq GROUP BY session
UNION ALL SELECT session, 'mcp-definition-weight', 'info', idle_servers, carried_tokens, NULL FROM wt WHERE carried_tokens >= 500000""",
}
