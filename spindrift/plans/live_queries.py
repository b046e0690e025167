"""Live facts of landed transcripts, and the same from all lines at once in SQL."""

from __future__ import annotations

from ..sources.live import live_kinds
from ..streaming.board import PLACES, RING, boards_of_landed
from ..streaming.board import QUIET_MS as BOARD_QUIET_MS
from ..streaming.live import DELAY, QUIET_MS, landed_live
from .transcript_queries import line_expressions

assert DELAY == "1 hour"
_PARTS = ", ".join(f"CASE WHEN {cond} THEN {line} END" for cond, line in [*line_expressions("to_json(coalesce(text, ''))"), *live_kinds()])
ACTIONS = f"""
WITH k0 AS (SELECT concat('s', conv_id) AS session, turn * 100 + generate_subscripts(x, 1) - 1 AS number, unnest(x) AS line FROM (SELECT conv_id, turn, [{_PARTS}] AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
l AS (SELECT *, starts_with(line, '{{') AND coalesce(json_valid(line), false) AS good FROM k0 WHERE line IS NOT NULL AND line <> ''),
m0 AS (SELECT session, number, line::JSON AS j FROM l WHERE good),
m AS (SELECT session, number, j, j->>'$.type' AS type, j->>'$.subtype' AS sub, j->'$.message.content' AS c, j->'$.message.usage' AS u, (CASE WHEN t <= 1e12 THEN t * 1000 ELSE t END)::BIGINT AS ms FROM (SELECT *, TRY_CAST(j->>'$.timestamp' AS DOUBLE) AS t FROM m0)),
b AS (SELECT session, number, ms, type, j, generate_subscripts(bs, 1) AS i, unnest(bs) AS b FROM (SELECT *, c::JSON[] AS bs FROM m WHERE json_type(c) = 'ARRAY')),
p AS (SELECT session, number, ms, type, c->>'$' AS text FROM m WHERE json_type(c) = 'VARCHAR'),
a AS (
 SELECT session, number * 1000 AS ord, NULL::BIGINT AS ms, 'bad' AS kind, NULL AS id, NULL AS tool, NULL AS text, NULL AS path, NULL AS status, NULL::BIGINT AS tokens FROM l WHERE NOT good
 UNION ALL SELECT session, number * 1000 + 1, ms, 'branch', NULL, NULL, j->>'$.gitBranch', NULL, NULL, NULL FROM m WHERE j->>'$.gitBranch' IS NOT NULL
 UNION ALL SELECT session, number * 1000 + 10 + i, ms, 'result', b->>'$.tool_use_id', NULL, NULL, NULL, CASE WHEN j->>'$.toolUseResult.backgroundTaskId' IS NOT NULL THEN 'launched' END, NULL FROM b WHERE type = 'user' AND b->>'$.type' = 'tool_result'
 UNION ALL SELECT session, number * 1000 + 20, ms, CASE WHEN text LIKE '<task-notification>%' THEN 'notification' ELSE 'prompt' END, regexp_extract(text, '<tool-use-id>([^<]*)<', 1), NULL, CASE WHEN text NOT LIKE '<%' THEN text END, NULL,
   CASE WHEN text LIKE '%<status>%' THEN 'ended' END, NULL FROM p WHERE type = 'user' AND NOT starts_with(text, '[Request interrupted')
 UNION ALL SELECT session, number * 1000 + 30, ms, 'clear', NULL, NULL, NULL, NULL, NULL, NULL FROM m WHERE type = 'assistant' AND j->>'$.message.model' <> '<synthetic>'
 UNION ALL SELECT session, number * 1000 + 32, ms, 'context', NULL, NULL, NULL, NULL, NULL, (u->>'$.input_tokens')::BIGINT + (u->>'$.cache_read_input_tokens')::BIGINT + (u->>'$.cache_creation_input_tokens')::BIGINT FROM m WHERE type = 'assistant' AND u IS NOT NULL AND j->>'$.message.model' <> '<synthetic>'
 UNION ALL SELECT session, number * 1000 + 40 + i, ms, 'call', b->>'$.id', b->>'$.name', NULL, CASE WHEN b->>'$.name' = 'Edit' THEN b->>'$.input.file_path' END,
   CASE WHEN b->>'$.name' = 'Task' THEN 'subagent' WHEN b->>'$.input.run_in_background' = 'true' THEN 'background' END, NULL FROM b WHERE type = 'assistant' AND b->>'$.type' = 'tool_use'
 UNION ALL SELECT session, number * 1000 + 40 + i, ms, 'reply', NULL, NULL, b->>'$.text', NULL, NULL, NULL FROM b WHERE type = 'assistant' AND b->>'$.type' = 'text' AND trim(b->>'$.text') <> '' AND j->>'$.message.model' <> '<synthetic>'
 UNION ALL SELECT session, number * 1000 + 70, ms, CASE sub WHEN 'turn_duration' THEN 'turn-end' ELSE 'error' END, NULL, NULL, j->>'$.error.message', NULL, replace(sub, '_', '-'), NULL FROM m WHERE type = 'system'
 UNION ALL SELECT session, number * 1000 + 80, ms, 'pr', NULL, NULL, j->>'$.prUrl', NULL, NULL, NULL FROM m WHERE type = 'pr-link'),
x AS (SELECT *, count(CASE WHEN kind = 'prompt' THEN 1 END) OVER (PARTITION BY session ORDER BY ord) AS t FROM a)"""
FACTS = ACTIONS + f""",
n AS (SELECT session, count(*) AS records, count(CASE WHEN kind = 'prompt' THEN 1 END) AS turns, arg_max(text, CASE WHEN kind = 'prompt' AND text IS NOT NULL THEN ord END) AS last_prompt, arg_max(text, CASE WHEN kind = 'reply' THEN ord END) AS last_reply,
   arg_max(text, CASE WHEN kind = 'branch' THEN ord END) AS branch, arg_max(ms, CASE WHEN kind = 'turn-end' AND ms IS NOT NULL THEN ord END) AS last_turn_end, arg_max(tokens, CASE WHEN kind = 'context' THEN ord END) AS context_tokens,
   count(CASE WHEN kind = 'bad' THEN 1 END) AS bad, max(ms) AS last_at FROM x GROUP BY session),
e AS (SELECT session, arg_max(struct_pack(kind := kind, status := status, text := text), ord) AS e FROM x WHERE kind IN ('error', 'clear', 'prompt') GROUP BY 1),
c AS (SELECT session, id, max(ord) AS ord, any_value(tool) AS tool, any_value(ms) AS ms, any_value(status) AS task, max(t) AS t FROM x WHERE kind = 'call' GROUP BY ALL),
res AS (SELECT r.session AS session, r.id AS id, r.ms AS r_at, r.status AS launched, c.id IS NOT NULL AND row_number() OVER (PARTITION BY r.session, r.id, r.t ORDER BY r.ord) = 1 AS hit, c.ms AS c_at
  FROM x r LEFT JOIN c ON c.session = r.session AND c.id = r.id AND c.t = r.t AND c.ord < r.ord WHERE r.kind = 'result'),
rc AS (SELECT session, count(CASE WHEN hit THEN 1 END) AS closed_calls, coalesce(sum(CASE WHEN hit AND r_at >= c_at THEN r_at - c_at END), 0)::BIGINT AS closed_ms, count(CASE WHEN NOT hit THEN 1 END) AS late_results FROM res GROUP BY 1),
cc AS (SELECT c.*, res.hit IS NOT NULL AS closed, coalesce(res.launched = 'launched', false) AS launched, c.t < n.turns AS past, EXISTS (FROM x o WHERE o.session = c.session AND o.kind = 'notification' AND o.id = c.id AND o.status = 'ended' AND o.ord > c.ord) AS told
  FROM c JOIN n ON n.session = c.session LEFT JOIN res ON res.session = c.session AND res.id = c.id AND res.hit),
cs AS (SELECT session, count(CASE WHEN NOT closed AND past THEN 1 END) AS dropped_calls, coalesce(string_agg(CASE WHEN NOT closed AND NOT past THEN id END, ',' ORDER BY ord), '') AS open_calls, arg_max(id, CASE WHEN NOT closed AND NOT past AND tool = 'AskUserQuestion' THEN ord END) AS question,
   count(CASE WHEN task IS NOT NULL AND ((closed AND NOT launched) OR (NOT closed AND past) OR told) THEN 1 END) AS ended_tasks,
   coalesce(string_agg(CASE WHEN task IS NOT NULL AND NOT ((closed AND NOT launched) OR (NOT closed AND past) OR told) THEN id END, ',' ORDER BY id), '') AS running_tasks FROM cc GROUP BY 1),
f AS (SELECT session, string_agg(concat(path, ':', tool, ':', ms), ',' ORDER BY ms, path) AS files FROM (SELECT session, path, arg_max(tool, ord) AS tool, arg_max(ms, ord) AS ms FROM x WHERE path IS NOT NULL AND ms IS NOT NULL GROUP BY ALL) GROUP BY 1),
k AS (SELECT session, string_agg(text, ',' ORDER BY o) AS links FROM (SELECT session, text, min(ord) AS o FROM x WHERE kind = 'pr' GROUP BY ALL) GROUP BY 1),
h0 AS (SELECT session, t, arg_max(text, CASE WHEN kind = 'prompt' THEN ord END) AS prompt, arg_max(text, CASE WHEN kind = 'reply' THEN ord END) AS reply, arg_max(ms, CASE WHEN kind = 'turn-end' THEN ord END) AS done, row_number() OVER (PARTITION BY session ORDER BY t DESC) AS q
  FROM x GROUP BY session, t HAVING t > 0 OR count(CASE WHEN kind = 'reply' THEN 1 END) > 0),
h AS (SELECT session, string_agg(concat(coalesce(prompt, '-'), '>', coalesce(length(reply)::VARCHAR, '-'), '>', coalesce(done::VARCHAR, '-')), '|' ORDER BY t) AS history FROM h0 WHERE q <= 10 GROUP BY 1)
SELECT n.session AS session, records, turns, last_prompt, last_reply, coalesce(closed_calls, 0) AS closed_calls, coalesce(closed_ms, 0) AS closed_ms, coalesce(dropped_calls, 0) AS dropped_calls, coalesce(late_results, 0) AS late_results, coalesce(ended_tasks, 0) AS ended_tasks,
 branch, CASE WHEN e.e.kind = 'error' THEN e.e.status END AS error, CASE WHEN e.e.kind = 'error' THEN e.e.text END AS error_text, last_turn_end, context_tokens, bad, last_at, coalesce(open_calls, '') AS open_calls, question, coalesce(running_tasks, '') AS running_tasks,
 coalesce(files, '') AS files, coalesce(links, '') AS links, coalesce(history, '') AS history, coalesce(last_at + {QUIET_MS} <= (SELECT max(ms) FROM m) - 3600000, false) AS ended
FROM n LEFT JOIN e USING (session) LEFT JOIN rc USING (session) LEFT JOIN cs USING (session) LEFT JOIN f USING (session) LEFT JOIN k USING (session) LEFT JOIN h USING (session)"""

_BOARDS = ACTIONS + f""",
c0 AS (SELECT min(conv_id) AS lo, max(conv_id) AS hi FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
y AS (SELECT x.*, least(5, ((substr(session, 2)::BIGINT - lo) * 6) // (hi - lo + 1) + CASE WHEN ord // 1000 >= 300 THEN 1 ELSE 0 END) AS part FROM x, c0),
z AS (SELECT k, y.*, max(t) OVER (PARTITION BY k, session) AS now_t FROM y JOIN (SELECT unnest(range(0, 6)) AS k) q ON part <= k),
st AS (SELECT k, session, max(now_t) AS turns, count(CASE WHEN kind = 'call' THEN 1 END) AS calls, max(ms) AS last_at, list(tool ORDER BY ord) FILTER (kind = 'call') AS tools,
  count(DISTINCT CASE WHEN kind = 'call' AND status = 'subagent' AND t = now_t AND NOT EXISTS (FROM z r WHERE r.k = z.k AND r.session = z.session AND r.kind = 'result' AND r.id = z.id AND r.ord > z.ord) THEN id END) AS running_agents FROM z GROUP BY ALL),
lv AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY last_at DESC, session) AS place FROM (SELECT *, max(last_at) OVER (PARTITION BY k) AS now FROM st) WHERE now - last_at < {BOARD_QUIET_MS}),
bd AS (SELECT k, place::INT AS place, session, turns, calls, running_agents, coalesce(array_to_string(tools[-{RING}:], ','), '') AS recent, last_at FROM lv WHERE place <= {PLACES}),
ch AS (SELECT k, said IS DISTINCT FROM lag(said) OVER (ORDER BY k) AS new FROM (SELECT k, string_agg(concat_ws('/', place, session, turns, calls, running_agents, recent), '|' ORDER BY place) AS said FROM bd GROUP BY k))
SELECT k AS batch, place, session, turns, calls, running_agents, recent, last_at FROM bd JOIN ch USING (k) WHERE new"""

QUERIES = {name: (lambda spark, sf_dir, f=f: f(spark.read.parquet(f"{sf_dir}/conversations.parquet"))) for name, f in (("live_facts", landed_live), ("live_boards", boards_of_landed))}
ORACLE = {"live_facts": FACTS, "live_boards": _BOARDS}
