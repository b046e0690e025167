"""What a live reader of transcripts acts on: each line of a session as actions in order.

``live_lines`` gives the lines, from ``conversations``: those of the transcript files and the kinds that matter while a
session runs (questions, background commands, agents, notifications, turn ends, errors, late and stray results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import transcripts as ts

ACTION = "kind: string, id: string, tool: string, text: string, path: string, status: string, tokens: bigint"
FIELDS = [f.split(":")[0] for f in ACTION.split(", ")]
FILE_TOOLS = ("Edit", "MultiEdit", "NotebookEdit", "Write")
_SCHEMA = ts.SCHEMA + ", subtype string, prUrl string, isApiErrorMessage boolean, isCompactSummary boolean, toolUseResult struct<status: string, backgroundTaskId: string>, error struct<message: string>"

_AT = "(1704067200 + conv_id * 3600 + turn * 60 + {s}) * 1000"
_USE = "concat('{{\"type\":\"assistant\",\"uuid\":\"{k}', conv_id, '-', turn, '\",\"timestamp\":', {at}, ',\"message\":{{\"id\":\"{k}', conv_id, '-', turn, '\",\"role\":\"assistant\",\"model\":\"large-4\",\"content\":[{{\"type\":\"tool_use\",\"id\":\"{k}', conv_id, '-', turn, '\",\"name\":\"{tool}\",\"input\":{input}}}]}}}}')"
_RESULT = "concat('{{\"type\":\"user\",\"uuid\":\"r{k}', conv_id, '-', turn, '\",\"timestamp\":', {at}, ',\"message\":{{\"role\":\"user\",\"content\":[{{\"type\":\"tool_result\",\"tool_use_id\":\"', {id}, '\",\"is_error\":false,\"content\":\"ok\"}}]}}{more}}}')"


def live_kinds() -> list[tuple[str, str]]:
    """(condition, line) of each further kind of line; the same words in both engines."""

    def use(k: str, tool: str, given: str, s: int) -> str:
        return _USE.format(k=k, tool=tool, input=given, at=_AT.format(s=s))

    def result(k: str, name: str, s: int, more: str = "") -> str:
        return _RESULT.format(k=k, id=name, at=_AT.format(s=s), more=more)

    own = "concat('{k}', conv_id, '-', turn)".format
    note = "concat('{\"type\":\"user\",\"uuid\":\"n', conv_id, '-', turn, '\",\"timestamp\":', " + _AT.format(s=3) + ", ',\"message\":{\"role\":\"user\",\"content\":\"<task-notification><tool-use-id>g', conv_id, '-', turn - 1, '</tool-use-id>', CASE WHEN conv_id % 16 = 2 THEN '<status>completed</status>' ELSE '' END, '</task-notification>\"}}')"
    ended = "concat('{\"type\":\"system\",\"subtype\":\"turn_duration\",\"gitBranch\":\"b', turn % 3, '\",\"timestamp\":', " + _AT.format(s=40) + ", '}')"
    failed = "concat('{\"type\":\"system\",\"subtype\":\"', CASE WHEN turn % 2 = 0 THEN 'api_error' ELSE 'api_retry' END, '\",\"timestamp\":', " + _AT.format(s=41) + ", ',\"error\":{\"message\":\"overloaded ', turn, '\"}}')"
    link = "concat('{\"type\":\"pr-link\",\"prUrl\":\"https://host/p', conv_id % 5, '/', turn % 2, '\"}')"
    return [
        ("role = 'assistant' AND conv_id % 3 = 1", use("q", "AskUserQuestion", '{{"questions":[{{"question":"Which one?"}}]}}'.replace("{{", "{").replace("}}", "}"), 20)), ("role = 'assistant' AND conv_id % 3 = 1 AND turn % 4 = 1", result("q", own(k="q"), 25)),
        ("role = 'assistant' AND conv_id % 4 = 2", use("g", "Bash", '{"command":"make watch","run_in_background":true}', 26)), ("role = 'assistant' AND conv_id % 4 = 2", result("g", own(k="g"), 27, ',\"toolUseResult\":{{\"backgroundTaskId\":\"b1\"}}'.replace("{{", "{").replace("}}", "}"))),
        ("role = 'user' AND conv_id % 8 = 2 AND turn >= 2", note), ("role = 'assistant' AND conv_id % 6 = 3", use("t", "Task", '{"prompt":"look around","subagent_type":"scout"}', 28)),
        ("role = 'assistant' AND conv_id % 2 = 0", ended), ("role = 'assistant' AND conv_id % 9 = 4 AND turn % 3 = 1", failed), ("conv_id % 10 = 7", link),
        ("role = 'assistant' AND conv_id % 11 = 5", result("z", "'zz'", 30)), ("role = 'user' AND conv_id % 7 = 6 AND turn >= 2", result("l", "concat('c', conv_id, '-', turn - 1)", 31)),
    ]


def live_lines(conversations: DataFrame) -> DataFrame:
    """session, number, line, in the order of writing."""
    from ..plans.transcript_queries import line_expressions

    q = "substr(to_json(named_struct('a', coalesce(text, ''))), 6, length(to_json(named_struct('a', coalesce(text, '')))) - 6)"
    lines = F.array(*[F.expr(f"CASE WHEN {cond} THEN {line} END") for cond, line in [*line_expressions(q), *live_kinds()]])
    rows = conversations.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode(lines).alias("n", "line")).filter("line is not null and line <> ''")
    return rows.select(F.concat(F.lit("s"), "conv_id").alias("session"), (F.col("turn") * 100 + F.col("n")).cast("long").alias("number"), "line")


def actions(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """session, ord, ``keep``, at (ms) and the fields of ``ACTION``: what each line means to a live reader, several to a line in their order.

    Kinds: prompt (starts a turn), notification, result, call, reply, context, error, clear, turn-end, branch, pr, bad. A line that is
    no JSON object is ``bad``; lines without meaning give nothing. Side chains are left out.
    """
    listed = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ts.BLOCK.split(', '))}>>"
    good = F.col("line").startswith("{") & F.try_parse_json("line").isNotNull()
    rows = lines.select("session", "number", *keep, good.alias("good"), F.from_json(F.when(good, F.col("line")), _SCHEMA).alias("r"))
    content = F.col("r.message.content")
    rows = rows.withColumns({"at": ts.time_ms(F.col("r.timestamp")), "blocks": F.when(content.startswith("[{"), F.from_json(content, listed)), "plain": F.when(~content.startswith("[{"), content)})

    def one(kind: str, **given: Column) -> Column:
        parts = [F.lit(kind).alias("kind"), *[given.get(f, F.lit(None)).cast("bigint" if f == "tokens" else "string").alias(f) for f in FIELDS[1:]]]
        return F.struct(*parts)

    none = F.array().cast(f"array<struct<{ACTION}>>")
    when = lambda cond, *made: F.when(F.coalesce(cond, F.lit(False)), F.array(*made)).otherwise(none)
    kind, text = tx.prompt_kind(F.coalesce("plain", F.lit("")), F.col("r.isMeta")), F.col("plain")
    user, assistant, system = F.col("r.type") == "user", F.col("r.type") == "assistant", F.col("r.type") == "system"
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    launched = (F.col("r.toolUseResult.status") == "async_launched") | F.col("r.toolUseResult.backgroundTaskId").isNotNull()
    of_results = F.transform(results, lambda b: one("result", id=b["tool_use_id"], status=F.when(F.coalesce(launched, F.lit(False)) & ~F.coalesce(b["is_error"], F.lit(False)), "launched")))
    api_error = F.coalesce(F.col("r.isApiErrorMessage"), F.lit(False))
    reply = assistant & ~api_error & (F.coalesce(F.col("r.message.model"), F.lit("")) != "<synthetic>")
    usage = F.col("r.message.usage")
    tokens = F.coalesce(usage["input_tokens"], F.lit(0)) + F.coalesce(usage["cache_read_input_tokens"], F.lit(0)) + F.coalesce(usage["cache_creation_input_tokens"], F.lit(0))
    named = lambda b, k: F.get_json_object(b["input"], f"$.{k}")
    task = lambda b: F.when(b["name"].isin("Agent", "Task"), "subagent").when((b["name"] == "Bash") & (named(b, "run_in_background") == "true"), "background")
    of_blocks = F.transform(
        F.filter("blocks", lambda b: (b["type"] == "tool_use") | ((b["type"] == "text") & (F.trim(b["text"]) != "") & reply)),
        lambda b: F.when(b["type"] == "text", one("reply", text=b["text"])).when(b["id"].isNull() | b["name"].isNull(), one("bad"))
        .otherwise(one("call", id=b["id"], tool=b["name"], path=F.when(b["name"].isin(*FILE_TOOLS), F.coalesce(named(b, "file_path"), named(b, "notebook_path"))), status=task(b))),
    )
    every = F.concat(
        when(~F.col("good"), one("bad")), when(F.col("r.gitBranch").isNotNull(), one("branch", text=F.col("r.gitBranch"))),
        F.when(user & (F.size(results) > 0), of_results).otherwise(none),
        when(user & text.isNotNull() & kind.isin("human", "command", "peer", "scheduled") & ~F.coalesce(F.col("r.isCompactSummary"), F.lit(False)), one("prompt", text=F.when(kind == "human", text), status=kind)),
        when(user & (kind == "notification"), one("notification", id=F.regexp_extract(text, "<tool-use-id>([^<]*)</tool-use-id>", 1), status=F.when(text.contains("<status>"), "ended"))),
        when(reply, one("clear")), when(assistant & api_error, one("error", status=F.lit("api-error"))), when(reply & usage.isNotNull(), one("context", tokens=tokens)),
        F.when(assistant & F.col("blocks").isNotNull(), of_blocks).otherwise(none), when(reply & text.isNotNull() & (F.trim(text) != ""), one("reply", text=text)),
        when(system & (F.col("r.subtype") == "turn_duration"), one("turn-end")),
        when(system & F.col("r.subtype").isin("api_error", "api_retry"), one("error", status=F.translate(F.col("r.subtype"), "_", "-"), text=F.col("r.error.message"))),
        when((F.col("r.type") == "pr-link") & F.col("r.prUrl").isNotNull(), one("pr", text=F.col("r.prUrl"))),
    )
    rows = rows.filter("not coalesce(r.isSidechain, false)").select("session", "number", *keep, "at", F.posexplode(every).alias("k", "a"))
    return rows.select("session", (F.col("number") * 1000 + F.col("k")).cast("long").alias("ord"), *keep, "at", "a.*")
