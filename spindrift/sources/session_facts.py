"""Facts of a session from the records of its transcript: compactions, hooks, attachments, listings, queue, meta, events, hidden iterations.

``fact_records`` parses lines and gives every record its turn; each function after it takes those records and gives rows of one kind of
fact. Lines move once, by session; a session is one file, whose size the scan limits. Lines that are no JSON objects give nothing; missing
fields are null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core
from . import transcripts as ts

_TOKENS = "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long"
_SCHEMA = (
    "type string, subtype string, uuid string, timestamp string, cwd string, gitBranch string, version string, entrypoint string, permissionMode string, agentId string, effort string,"
    " isMeta boolean, isSidechain boolean, isCompactSummary boolean, isApiErrorMessage boolean, isVisibleInTranscriptOnly boolean, apiErrorStatus string, error string, origin struct<kind: string>, promptSource string,"
    " content string, operation string, prNumber string, prUrl string, path string, durationMs long, cronKind string, attachment string, hookInfos array<struct<command: string, durationMs: long>>, hookErrors array<string>,"
    " compactMetadata struct<trigger: string, preTokens: long, postTokens: long, durationMs: long, cumulativeDroppedTokens: long>,"
    f" message struct<id: string, role: string, model: string, stop_reason: string, content: string, diagnostics: struct<cache_miss_reason: struct<type: string, cache_missed_input_tokens: long>>, usage: struct<{_TOKENS.replace(' long', ': long')},"
    f" output_tokens_details: struct<thinking_tokens: long>, iterations: array<struct<type: string, model: string, {_TOKENS.replace(' long', ': long')}>>>>"
)
_ATTACHMENT = (
    "type string, hookEvent string, hookName string, command string, durationMs long, exitCode long, names array<string>, skillCount long, isInitial boolean,"
    " files array<struct<path: string, type: string, content: string>>, addedNames array<string>, readdedNames array<string>, commandMode string"
)
_BLOCKS = "array<struct<type: string, text: string, id: string, name: string, input: string, from: struct<model: string>, to: struct<model: string>>>"
MESSAGES = ("user", "assistant", "system")
#: Fixed value: lines a task; parsed records are wide, and each window over them sorts them.
LINES = 10_000
#: Attachments that each record one hook run, and those of a run that did not end well.
HOOK_RUNS = ("hook_success", "hook_error", "hook_failure", "hook_cancelled", "hook_non_blocking_error", "async_hook_response")
HOOK_FAILED = ("hook_error", "hook_failure", "hook_cancelled", "hook_non_blocking_error")
#: Tokens that one listed tool costs a request, tools of a server worth naming, and the carried tokens from which the rule speaks.
LISTED_TOKENS, IDLE_TOOLS, CARRIED = 25, 5, 500_000
#: A question that waits longer than this is worth a word, a medium one, a high one (ms).
ASKED, ASKED_MEDIUM, ASKED_HIGH = 5 * 60_000, 30 * 60_000, 2 * 3_600_000


def fact_records(lines: DataFrame) -> DataFrame:
    """session, ord, ms, r, a (attachment), agent_id, side, blocks, text, kind (of a prompt), starts, main_turn, turn of each line (session, number, line).

    Messages whose uuid came before are dropped. ``main_turn`` counts the prompts of the main thread that start a turn, from 0 (-1 before
    the first); ``turn`` is the same but in an agent's own count for its records. A compaction's summary and tool results start none.
    """
    rows = core.dealt(lines, ["session"], lines.count(), LINES).filter(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull())
    rows = rows.select("session", F.col("number").alias("ord"), F.from_json("line", _SCHEMA).alias("r"))
    once = F.when(F.col("r.type").isin(*MESSAGES) & F.col("r.uuid").isNotNull(), F.col("r.uuid")).otherwise(F.concat(F.lit("#"), "ord"))
    rows = core.first_by(rows.withColumn("_once", once), ["session", "_once"], ["ord"]).drop("_once")
    content = F.col("r.message.content")
    listed = F.when(content.startswith("[{"), F.from_json(content, _BLOCKS))
    of_blocks = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    user, side = F.col("r.type") == "user", F.coalesce("r.isSidechain", F.lit(False))
    rows = rows.withColumns({"ms": ts.time_ms(F.col("r.timestamp")), "a": F.from_json("r.attachment", _ATTACHMENT), "blocks": listed, "agent_id": F.col("r.agentId"), "side": side})
    rows = rows.withColumn("text", F.coalesce(F.when(F.col("r.type") == "system", F.col("r.content")).otherwise(F.when(F.col("blocks").isNotNull(), of_blocks).otherwise(content)), F.lit("")))
    asks = user & ~F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False)) & ~F.coalesce("r.isCompactSummary", F.lit(False)) & F.col("r.message").isNotNull()
    rows = rows.withColumn("kind", F.when(asks, tx.prompt_kind(F.col("text"), F.col("r.isMeta"), F.col("r.origin.kind"), F.col("r.promptSource"), F.col("r.isVisibleInTranscriptOnly"))))
    rows = rows.withColumn("starts", F.coalesce(F.col("kind").isin("human", "command", "peer", "scheduled"), F.lit(False)))
    main, own = F.col("starts") & ~F.col("side"), F.col("starts") & F.col("side") & ~F.coalesce("r.isMeta", F.lit(False)) & F.col("agent_id").isNotNull()
    rows = core.running_index(rows, ["session"], ["ord"], main, "main_turn")
    rows = core.running_index(rows, ["session", "agent_id"], ["ord"], own, "_own")
    return rows.withColumn("turn", F.when(F.col("agent_id").isNull(), F.col("main_turn")).otherwise(F.greatest("_own", F.lit(0)))).drop("_own")


def compactions(rec: DataFrame) -> DataFrame:
    """One row per compaction: a boundary with the length of the summary that comes next, or a summary without a boundary (trigger ``unknown``).

    A boundary that another one follows stays without a summary; of two summaries after a boundary the second stands alone.
    """
    border, summary = F.coalesce((F.col("r.type") == "system") & (F.col("r.subtype") == "compact_boundary"), F.lit(False)), F.coalesce("r.isCompactSummary", F.lit(False))
    w = Window.partitionBy("session").orderBy("ord")
    rows = rec.filter(border | summary).withColumn("is_summary", ~border).withColumn("chars", F.length("text").cast("long"))
    rows = rows.withColumn("follows", F.lag("is_summary").over(w)).withColumn("next", F.when(F.lead("is_summary").over(w), F.lead("chars").over(w)))
    rows = rows.filter("not is_summary or follows is null or follows")
    m = F.col("r.compactMetadata")
    return rows.select(
        "session", "ord", "turn", "ms", F.when(F.col("is_summary"), "unknown").otherwise(F.coalesce(m["trigger"], F.lit("unknown"))).alias("trigger"), m["preTokens"].alias("context_before"), m["postTokens"].alias("context_after"),
        m["durationMs"].alias("duration_ms"), m["cumulativeDroppedTokens"].alias("dropped_tokens"), F.when(F.col("is_summary"), F.col("chars")).otherwise(F.col("next")).alias("summary_chars"),
    )


def hook_runs(rec: DataFrame) -> DataFrame:
    """session, ord, n, turn, event, name, command, duration_ms, ok: attachments that record a run, and the entries of the summaries of Stop hooks.

    Output of a run that has its own record is none; Stop attachments are in the summaries. A run is ok if its kind says so and it left with 0 or without a code.
    """
    of_runs = rec.filter((F.col("r.type") == "attachment") & F.col("a.type").isin(*HOOK_RUNS) & (F.col("a.hookEvent") != "Stop") & (F.col("a.hookEvent") != "")).select(
        "session", "ord", F.lit(0).alias("n"), F.col("main_turn").alias("turn"), F.col("a.hookEvent").alias("event"), F.col("a.hookName").alias("name"), F.col("a.command").alias("command"), F.col("a.durationMs").alias("duration_ms"),
        (~F.col("a.type").isin(*HOOK_FAILED) & (F.coalesce("a.exitCode", F.lit(0)) == 0)).alias("ok"),
    )
    stop = rec.filter((F.col("r.type") == "system") & (F.col("r.subtype") == "stop_hook_summary"))
    entry = lambda command, ms, ok: F.struct(command.alias("command"), ms.cast("long").alias("duration_ms"), F.lit(ok).alias("ok"))
    infos = F.transform(F.coalesce("r.hookInfos", F.array().cast("array<struct<command: string, durationMs: long>>")), lambda h: entry(h["command"], h["durationMs"], True))
    errors = F.transform(F.coalesce("r.hookErrors", F.array().cast("array<string>")), lambda e: entry(F.coalesce(F.get_json_object(e, "$.command"), tx.preview(e, 80)), F.lit(None), False))
    of_stops = stop.select("session", "ord", "turn", F.posexplode(F.concat(infos, errors)).alias("n", "h")).select("session", "ord", "n", "turn", F.lit("Stop").alias("event"), F.lit(None).cast("string").alias("name"), "h.command", "h.duration_ms", "h.ok")
    return of_runs.unionByName(of_stops)


def hooks_by_command(runs: DataFrame) -> DataFrame:
    """Runs, time and errors per session and what a hook is known by (command, else name, else event), its busiest event (ties by name) and all its events."""
    key = F.coalesce("command", "name", "event")
    by = F.when(F.col("command").isNotNull(), "command").when(F.col("name").isNotNull(), "name").otherwise("event")
    each = runs.groupBy("session", key.alias("hook"), by.alias("known_by"), "event").agg(F.count("*").alias("n"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("ms"), F.count(F.when(~F.col("ok"), 1)).alias("bad"))
    every = F.array_sort(F.collect_list(F.struct("event", "n")))
    return each.groupBy("session", "hook", "known_by").agg(
        F.sum("n").alias("runs"), F.sum("ms").alias("total_ms"), F.sum("bad").alias("errors"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "event")))[0]["event"].alias("event"),
        F.array_join(F.transform(every, lambda e: F.concat(e["event"], F.lit("="), e["n"].cast("string"))), ",").alias("events"),
    )


def attachments(rec: DataFrame) -> DataFrame:
    """Attachments of each type: number and bytes in all, and those of the main thread alone."""
    rows = rec.filter(F.col("r.type") == "attachment").select("session", F.coalesce("a.type", F.lit("unknown")).alias("type"), (~F.col("side") & F.col("agent_id").isNull()).alias("main"), F.octet_length(F.coalesce("r.attachment", F.lit(""))).cast("long").alias("b"))
    return rows.groupBy("session", "type").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"), F.count(F.when(F.col("main"), 1)).alias("main_n"), F.coalesce(F.sum(F.when(F.col("main"), F.col("b"))), F.lit(0)).alias("main_bytes"))


def session_meta(rec: DataFrame) -> DataFrame:
    """Branches, client versions, entry points, modes, efforts and models in order of first sight; first folder, first and last time, wall time, worktree."""
    given = {"branches": "r.gitBranch", "versions": "r.version", "entrypoints": "r.entrypoint", "modes": "r.permissionMode", "efforts": "r.effort", "models": "r.message.model"}
    own = {"modes": F.col("r.type") == "permission-mode"}
    pairs = [F.struct(F.lit(what).alias("what"), F.when(own.get(what, F.lit(True)), F.col(field)).alias("v")) for what, field in given.items()]
    seen = rec.select("session", "ord", F.explode(F.array(*pairs)).alias("p")).filter("p.v is not null and p.v <> '' and p.v <> '<synthetic>'").groupBy("session", "p.what", "p.v").agg(F.min("ord").alias("ord"))
    in_order = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("ord", "v")))), lambda x: x["v"]), ",").alias(what)
    lists = seen.groupBy("session").agg(*[in_order(what) for what in given])
    times = rec.groupBy("session").agg(F.min_by("r.cwd", F.when(F.col("r.cwd").isNotNull(), F.col("ord"))).alias("cwd"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.max(F.coalesce(F.col("r.type") == "worktree-state", F.lit(False))).alias("worktree"))
    return times.join(lists, "session", "left").select("session", "cwd", "first_ms", "last_ms", (F.col("last_ms") - F.col("first_ms")).alias("wall_ms"), "worktree", *[F.coalesce(what, F.lit("")).alias(what) for what in given])


def turn_flags(rec: DataFrame) -> DataFrame:
    """Of each turn of the main thread: notifications and local output that went on with it, whether it was interrupted, and the last duration that the client reported."""
    main = rec.filter("main_turn >= 0")
    went_on = ~F.col("side") & F.col("kind").isin("notification", "local_output")
    stopped = F.col("agent_id").isNull() & F.col("r.type").isin(*MESSAGES) & F.col("text").rlike(r"(?i)\[request interrupted by user")
    told = (F.col("r.type") == "system") & (F.col("r.subtype") == "turn_duration") & F.col("agent_id").isNull()
    return main.groupBy("session", F.col("main_turn").alias("turn")).agg(
        F.count(F.when(went_on, 1)).alias("auto_continuations"), F.max(F.coalesce(stopped, F.lit(False))).alias("interrupted"), F.max_by("r.durationMs", F.when(told, F.col("ord"))).alias("reported_ms"),
    )


def listings(rec: DataFrame) -> DataFrame:
    """What each session was given: skills (the last initial listing, else the first), deferred tools, instruction files by path and content, reads cut short."""
    a = rec.filter(F.col("r.type") == "attachment")
    initial = F.coalesce("a.isInitial", F.lit(False))
    skills = F.when(F.col("a.type") == "skill_listing", F.struct(initial.alias("initial"), F.when(initial, F.col("ord")).otherwise(-F.col("ord")).alias("o")))
    named = F.struct(F.coalesce("a.skillCount", F.size("a.names").cast("long")).alias("count"), F.array_join(F.coalesce("a.names", F.array().cast("array<string>")), ",").alias("names"))
    tools = F.when(F.col("a.type") == "deferred_tools_delta", F.concat(F.coalesce("a.addedNames", F.array().cast("array<string>")), F.coalesce("a.readdedNames", F.array().cast("array<string>"))))
    out = a.groupBy("session").agg(F.max_by(named, skills).alias("s"), F.count(F.when(F.col("a.type") == "read_truncation_notice", 1)).alias("truncated_reads"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tools)))), ",").alias("deferred_tools"))
    files = a.filter("a.type = 'instructions' and not side and agent_id is null").select("session", F.explode("a.files").alias("f")).filter("f.path <> '' and f.content is not null")
    files = files.groupBy("session").agg(F.count_distinct("f.path", "f.content").alias("instruction_files"), F.count_distinct("f.path").alias("instruction_paths"))
    return out.join(files, "session", "left").select("session", F.col("s.count").alias("skills"), F.col("s.names").alias("skill_names"), "truncated_reads", "deferred_tools", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instruction_files", "instruction_paths")])


def _notified() -> Column:
    return F.coalesce(F.col("r.content"), F.lit("")).rlike(r"^\s*<(?:task|system)-notification>")


def queue_operations(rec: DataFrame) -> DataFrame:
    """Operations on the queue of prompts by kind; what was put in, split into a person's prompts and notifications."""
    q = rec.filter(F.col("r.type") == "queue-operation").select("session", F.coalesce("r.operation", F.lit("unknown")).alias("operation"), _notified().alias("told"))
    put = F.col("operation") == "enqueue"
    return q.groupBy("session", "operation").agg(F.count("*").alias("n"), F.count(F.when(put & ~F.col("told"), 1)).alias("human"), F.count(F.when(put & F.col("told"), 1)).alias("notification"))


def event_stream(rec: DataFrame) -> DataFrame:
    """session, ord, n, ms, turn, kind, label, detail: what happened beside the messages, from one pass over the records.

    A pull request counts once, at its first record. Questions to the person are one event a session, of turn -1.
    """
    type_, sub, att = F.col("r.type"), F.col("r.subtype"), F.col("a.type")
    attached, system, message = type_ == "attachment", type_ == "system", type_.isin(*MESSAGES)
    text_error = F.when(~F.col("r.error").startswith("{"), F.col("r.error"))
    failed = message & (F.coalesce("r.isApiErrorMessage", F.lit(False)) | F.col("r.error").isNotNull())
    told = _notified()
    none = F.array().cast("array<struct<kind: string, label: string, detail: string, main: boolean>>")

    def one(kind, label, detail=None, main=False):
        text = lambda v: v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")
        return F.struct(text(kind).alias("kind"), text(label).alias("label"), text(detail).alias("detail"), F.lit(main).alias("main"))

    when = lambda cond, event: F.when(F.coalesce(cond, F.lit(False)), F.array(event)).otherwise(none)
    falls = F.transform(F.filter(F.coalesce("blocks", F.array().cast(_BLOCKS)), lambda b: b["type"] == "fallback"), lambda b: one("model_fallback", F.concat(F.lit("model fallback "), F.coalesce(b["from"]["model"], F.lit("?")), F.lit(" → "), F.coalesce(b["to"]["model"], F.lit("?")))))
    plans = F.transform(F.filter(F.coalesce("blocks", F.array().cast(_BLOCKS)), lambda b: (b["type"] == "tool_use") & b["name"].isin("EnterPlanMode", "ExitPlanMode")), lambda b: one("plan_mode", b["name"]))
    every = F.concat(
        when(type_ == "frame-link", one("other", "frame link", F.col("r.path"), True)),
        when(attached & (att == "queued_command"), one("other", "queued command", F.col("a.commandMode"), True)),
        when(attached & att.isin("ultra_effort_enter", "ultra_effort_exit", "plan_mode_exit"), one(F.when(att == "plan_mode_exit", "plan_mode").otherwise("other"), att, None, True)),
        when((type_ == "queue-operation") & (F.col("r.operation") == "enqueue"), one("other", F.when(told, "queued notification").otherwise("queued message"), tx.preview(F.coalesce("r.content", F.lit("")), 100), True)),
        when((type_ == "pr-link"), one("pr_link", F.concat(F.lit("PR #"), F.coalesce("r.prNumber", "r.prUrl", F.lit("?"))), F.col("r.prUrl"), True)),
        when(message & F.col("text").rlike(r"(?i)\[request interrupted by user"), one("interrupt", "Request interrupted by user")), F.when(message, falls).otherwise(none),
        when(failed, one("api_error", F.concat(F.lit("API error"), F.coalesce(F.concat(F.lit(" "), "r.apiErrorStatus"), F.lit(""))), tx.preview(F.coalesce(text_error, "text"), 200))),
        when(system & (sub == "scheduled_task_fire"), one("scheduled_fire", F.coalesce("r.cronKind", F.lit("scheduled")), tx.preview(F.col("text"), 120))),
        when(system & (sub == "away_summary"), one("away_summary", "away summary", tx.preview(F.col("text"), 200))),
        when(system & sub.isin("api_error", "api_retry"), one("api_error", sub, tx.preview(F.col("text"), 200))), F.when(type_ == "assistant", plans).otherwise(none),
    )
    rows = rec.select("session", "ord", "ms", "main_turn", "turn", F.posexplode(every).alias("n", "e"))
    rows = rows.select("session", "ord", "n", "ms", F.when(F.col("e.main"), F.col("main_turn")).otherwise(F.col("turn")).alias("turn"), "e.kind", "e.label", "e.detail")
    linked = F.col("kind") == "pr_link"
    once = core.first_by(rows.filter(linked), ["session", "label"], ["ord"]).unionByName(rows.filter(~linked))
    asked = rec.filter(type_ == "assistant").select("session", F.explode("blocks").alias("b")).filter("b.type = 'tool_use' and b.name = 'AskUserQuestion'").groupBy("session").agg(F.count("*").alias("c"))
    null = lambda t: F.lit(None).cast(t)
    return once.unionByName(asked.select("session", null("long").alias("ord"), F.lit(0).alias("n"), null("long").alias("ms"), F.lit(-1).alias("turn"), F.lit("permission_prompt").alias("kind"), F.concat(F.lit("AskUserQuestion x"), "c").alias("label"), null("string").alias("detail")))


def skill_uses(rec: DataFrame) -> DataFrame:
    """Skills by name: uses, ways in order of first use (a person's command, the tool), turns in order of first use."""
    command = F.regexp_extract("text", r"<command-name>\s*([^<\s]+)\s*</command-name>", 1)
    asked = rec.filter(F.col("starts") & ~F.col("side") & (command != "")).select("session", "ord", F.lit(0).alias("n"), command.alias("skill"), F.lit("command").alias("via"), F.col("main_turn").alias("turn"))
    used = rec.filter(F.col("r.type") == "assistant").select("session", "ord", "turn", F.posexplode("blocks").alias("n", "b")).filter("b.type = 'tool_use' and b.name = 'Skill'")
    used = used.select("session", "ord", "n", F.coalesce(F.get_json_object("b.input", "$.skill"), F.get_json_object("b.input", "$.name")).alias("skill"), F.lit("tool").alias("via"), "turn").filter("skill is not null")
    every = asked.unionByName(used)
    at = F.struct("ord", "n")
    firsts = lambda of: every.groupBy("session", "skill", of).agg(F.count("*").alias("c"), F.min(at).alias("at"))
    listed = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", of))), lambda x: x[of].cast("string")), ",")
    ways = firsts("via").groupBy("session", "skill").agg(F.sum("c").alias("uses"), listed("via").alias("via"))
    return ways.join(firsts("turn").groupBy("session", "skill").agg(listed("turn").alias("turns")), ["session", "skill"])


def requests(rec: DataFrame) -> DataFrame:
    """One row per provider message that counts (the part with a stop reason, then most output, then the last), with what its other parts say.

    session, request, ord, turn, agent_id, model, tokens, miss (first reason of a cache miss) and the tokens missed, most thinking tokens,
    category of its tool calls (one call its own, several ``mixed``, none ``no-tool``), iterations of the counted part.
    """
    u = F.col("r.message.usage")
    n = lambda f: F.coalesce(f, F.lit(0))
    total = n(u["input_tokens"]) + n(u["output_tokens"]) + n(u["cache_read_input_tokens"]) + n(u["cache_creation_input_tokens"])
    rows = rec.filter((F.col("r.type") == "assistant") & (F.coalesce("r.message.model", F.lit("")) != "<synthetic>"))
    calls = F.transform(F.filter(F.coalesce("blocks", F.array().cast(_BLOCKS)), lambda b: b["type"] == "tool_use"), lambda b: tx.tool_category(b["name"]))
    rows = rows.select("session", F.coalesce("r.message.id", F.concat(F.lit("#"), "ord")).alias("request"), "ord", "turn", "agent_id", F.col("r.message.model").alias("model"), F.when(u.isNotNull(), total).alias("tokens"), n(u["output_tokens"]).alias("output"),
                       F.col("r.message.stop_reason").isNotNull().alias("stop"), F.col("r.message.diagnostics.cache_miss_reason").alias("m"), u["output_tokens_details"]["thinking_tokens"].alias("thinking"), u["iterations"].alias("iterations"), calls.alias("calls"))
    best = F.when(F.col("tokens").isNotNull(), F.struct("stop", "output", "ord"))
    kept = F.max_by(F.struct("ord", "turn", "agent_id", "model", "tokens", "iterations"), best).alias("k")
    out = rows.groupBy("session", "request").agg(kept, F.min_by("m", F.when(F.col("m").isNotNull(), F.col("ord"))).alias("m"), F.max("thinking").alias("thinking_tokens"), F.flatten(F.collect_list("calls")).alias("calls")).filter("k is not null")
    category = F.when(F.size("calls") == 0, "no-tool").when(F.size("calls") == 1, F.get("calls", 0)).otherwise("mixed")
    return out.select("session", "request", "k.ord", "k.turn", "k.agent_id", "k.model", "k.tokens", F.when(F.col("m").isNotNull(), F.coalesce("m.type", F.lit("unknown"))).alias("miss"), F.col("m.cache_missed_input_tokens").alias("missed_tokens"), "thinking_tokens", category.alias("category"), "k.iterations")


def hidden_iterations(req: DataFrame) -> DataFrame:
    """Attempts of a request that were billed but gave no message: all but the last of the counted part's iterations."""
    n = lambda f: F.coalesce(f, F.lit(0))
    rows = req.filter(F.size("iterations") > 1).select("session", "request", "turn", "model", F.posexplode(F.slice("iterations", 1, F.size("iterations") - 1)).alias("n", "i")).filter("i is not null")
    return rows.select("session", "request", "n", "turn", F.coalesce("i.model", "model", F.lit("unknown")).alias("model"), F.coalesce("i.type", F.lit("iteration")).alias("type"), (n(F.col("i.input_tokens")) + n(F.col("i.output_tokens")) + n(F.col("i.cache_read_input_tokens")) + n(F.col("i.cache_creation_input_tokens"))).alias("tokens"))


def tokens_by_category(req: DataFrame) -> DataFrame:
    return req.groupBy("session", "category").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def fact_rules(rec: DataFrame, calls: DataFrame) -> DataFrame:
    """Rules on these facts: session, rule, severity, n, tokens, saving_ms.

    ``hidden-iterations`` (high if a refusal switched the model for the session, medium if a fallback gave a message, else info);
    ``blocking-questions`` of the tool calls (session, tool, start_ms, duration_ms): high above two hours while no agent worked, medium above half
    an hour, low above five minutes; ``mcp-definition-weight``: servers with five listed tools or more and no call, weighed by the requests that carried them.
    """
    req = requests(rec)
    switched = rec.filter((F.col("r.type") == "system") & (F.col("r.subtype") == "model_refusal_fallback")).select("session", F.lit(True).alias("switched")).distinct()
    hidden = hidden_iterations(req).groupBy("session").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count(F.when(F.col("type") == "fallback_message", 1)).alias("f")).join(switched, "session", "left")
    hidden = hidden.select("session", F.lit("hidden-iterations").alias("rule"), F.when(F.col("switched"), "high").when(F.col("f") > 0, "medium").otherwise("info").alias("severity"), "n", "tokens", F.lit(None).cast("long").alias("saving_ms"))
    asks = calls.filter((F.col("tool") == "AskUserQuestion") & (F.col("duration_ms") > ASKED)).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms")).withColumn("ask", F.struct("session", "call", "ord"))
    agents = rec.filter("agent_id is not null and ms is not null").groupBy("session", "agent_id").agg(F.min("ms").alias("a_start"), F.max("ms").alias("a_end"))
    worked = core.interval_overlap_join(asks, agents, ["session"], ("start_ms", "end_ms"), ("a_start", "a_end"), ASKED_HIGH).filter("a_start < end_ms and a_end > start_ms").select("ask", F.lit(True).alias("worked")).distinct()
    asks = asks.join(worked, "ask", "left").groupBy("session").agg(F.count("*").alias("n"), F.max((F.col("duration_ms") > ASKED_HIGH) & F.col("worked").isNull()).alias("high"), F.max("duration_ms").alias("most"), F.sum("duration_ms").alias("saving_ms"))
    asks = asks.select("session", F.lit("blocking-questions").alias("rule"), F.when(F.col("high"), "high").when(F.col("most") > ASKED_MEDIUM, "medium").otherwise("low").alias("severity"), "n", F.lit(None).cast("long").alias("tokens"), "saving_ms")
    idle = definition_weight(rec, calls, req).filter(F.col("carried_tokens") >= CARRIED)
    idle = idle.select("session", F.lit("mcp-definition-weight").alias("rule"), F.lit("info").alias("severity"), F.col("idle_servers").alias("n"), F.col("carried_tokens").alias("tokens"), F.lit(None).cast("long").alias("saving_ms"))
    return hidden.unionByName(asks).unionByName(idle)


def definition_weight(rec: DataFrame, calls: DataFrame, req: DataFrame) -> DataFrame:
    """Of each session: servers of the deferred tools that list five tools or more and were never called, their tools, and the tokens that the main requests carried for them (an estimate)."""
    given = rec.filter(F.col("a.type") == "deferred_tools_delta").select("session", F.explode(F.concat(F.coalesce("a.addedNames", F.array().cast("array<string>")), F.coalesce("a.readdedNames", F.array().cast("array<string>")))).alias("tool")).filter("tool like 'mcp\\_\\_%'").distinct()
    server = F.coalesce(F.get(F.split("tool", "__"), 1), F.col("tool"))
    called = calls.filter("tool like 'mcp\\_\\_%'").select("session", server.alias("server")).distinct()
    listed = given.groupBy("session", server.alias("server")).agg(F.count("*").alias("n")).filter(F.col("n") >= IDLE_TOOLS).join(called, ["session", "server"], "left_anti")
    main = req.filter("agent_id is null").groupBy("session").agg(F.count("*").alias("main_requests"))
    out = listed.groupBy("session").agg(F.count("*").alias("idle_servers"), F.sum("n").alias("idle_tools")).join(main, "session")
    return out.withColumn("carried_tokens", F.col("idle_tools") * LISTED_TOKENS * F.col("main_requests"))
