"""Threshold rules over sessions, from one pass: records are annotated by windows that all keep a session
together, one aggregation gives each session's facts, and every rule is a predicate over the facts.

A rule whose expression cannot be built is left out and named in the result (``rule-failed``); the others
go on. A finding's saving is at most what the session used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core
from ..sources.records import records_from_events
from .session_queries import REC, TOTAL

HIGH, MEDIUM, LOW, INFO = 3, 2, 1, 0
RULES: dict[str, Callable[[], tuple[Column, Column, Column]]] = {}
COMMANDS = ("npm test", "git commit -m done", "cat src/a.py", "git checkout -- f1", "make", "ls -la src")


def rule(name: str):
    """Register a rule: a function without arguments that gives (fires, severity, saving) over the facts."""

    def register(f):
        RULES[name] = f
        return f

    return register


def bound_records(events: DataFrame) -> DataFrame:
    """Records of ten users' week as one session, with the further fields that the rules read."""
    rec = records_from_events(events.withColumn("user_id", F.floor(F.col("user_id") / 10).cast("long")), deal=True)
    k, kind = F.col("k"), F.col("event_type")
    has = lambda cond, value: F.when(cond, value)
    command = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (k % 6 + 1).cast("int"))
    return rec.withColumns(
        {
            "main": F.col("agent_id").isNull(), "command": has(F.col("tool") == "Bash", command), "context": F.when(F.col("workspace") % 7 == 0, k.cast("long") * 10).otherwise(k.cast("long") * 2000), "input_bytes": (k * 1700).cast("long"), "thinking": (k * 40).cast("long"), "burst": (k * 100).cast("long"),
            "fresh": (k * 50).cast("long"), "cached": F.when(k % 2 == 0, k * 100).otherwise(k * 10).cast("long"), "wrote_1h": F.when(k % 5 < 4, k * 1000).otherwise(0).cast("long"), "wrote": (k * 1000).cast("long"),
            "compaction": (kind == "signup") & (k % 17 == 0), "interrupt": (kind == "signup") & (k % 11 == 5), "correction": (kind == "signup") & (k % 13 == 7), "queued": (kind == "signup") & (k % 3 == 0),
            "hook": k % 19 == 3, "api_error": F.col("is_error") & (k % 23 == 1), "fallback": k % 29 == 2, "unresolved": F.col("tool").isNotNull() & (k % 31 == 4), "truncated": (F.col("tool") == "Read") & (k % 9 == 0),
            "attached": has((kind == "view") & (k % 8 == 1), (k * 10_000).cast("long")), "miss": has(k % 37 == 6, (k * 4000).cast("long")), "depth": has(F.col("agent_id").isNotNull(), (k % 4).cast("int")),
            "error_text": has(F.col("is_error"), F.concat(F.element_at(F.array(F.lit("timeout"), F.lit("no file /tmp/x"), F.lit("exit"), F.lit("denied")), (k % 4 + 1).cast("int")), F.lit(" at "), k.cast("string"))),
        }
    )


BOUND = REC.replace("FROM events)", "FROM (SELECT * REPLACE (user_id // 10 AS user_id) FROM events))") + """,
b AS (SELECT *, agent_id IS NULL AS main, CASE WHEN tool = 'Bash' THEN CASE k % 6 WHEN 0 THEN 'npm test' WHEN 1 THEN 'git commit -m done' WHEN 2 THEN 'cat src/a.py' WHEN 3 THEN 'git checkout -- f1' WHEN 4 THEN 'make' ELSE 'ls -la src' END END AS command,
  CASE WHEN workspace % 7 = 0 THEN k::BIGINT * 10 ELSE k::BIGINT * 2000 END AS context, k::BIGINT * 1700 AS input_bytes, k::BIGINT * 40 AS thinking, k::BIGINT * 100 AS burst, k::BIGINT * 50 AS fresh, (CASE WHEN k % 2 = 0 THEN k * 100 ELSE k * 10 END)::BIGINT AS cached,
  (CASE WHEN k % 5 < 4 THEN k * 1000 ELSE 0 END)::BIGINT AS wrote_1h, k::BIGINT * 1000 AS wrote, event_type = 'signup' AND k % 17 = 0 AS compaction, event_type = 'signup' AND k % 11 = 5 AS interrupt,
  event_type = 'signup' AND k % 13 = 7 AS correction, event_type = 'signup' AND k % 3 = 0 AS queued, k % 19 = 3 AS hook, is_error AND k % 23 = 1 AS api_error, k % 29 = 2 AS fallback, tool IS NOT NULL AND k % 31 = 4 AS unresolved,
  coalesce(tool = 'Read' AND k % 9 = 0, false) AS truncated, CASE WHEN event_type = 'view' AND k % 8 = 1 THEN k::BIGINT * 10000 END AS attached, CASE WHEN k % 37 = 6 THEN k::BIGINT * 4000 END AS miss,
  CASE WHEN agent_id IS NOT NULL THEN k % 4 END AS depth,
  CASE WHEN is_error THEN CASE k % 4 WHEN 0 THEN 'timeout at <n>' WHEN 1 THEN 'no file <path> at <n>' WHEN 2 THEN 'exit at <n>' ELSE 'denied at <n>' END END AS signature FROM rec)"""


def annotated(b: DataFrame) -> DataFrame:
    """Each record with what its groups inside the session come to."""
    of = lambda *c: Window.partitionBy("session_id", *c)
    count = lambda cond, *c: F.count(F.when(cond, 1)).over(of(*c))
    read, call = F.col("tool") == "Read", F.col("tool").isNotNull()
    test = tx.command_class(F.col("command"))
    df = b.withColumns({"signature": F.when(F.col("is_error"), tx.error_signature(F.col("error_text"))), "class": F.when(F.col("command").isNotNull(), test)})
    df = df.withColumns(
        {
            "reads": count(read, "path"), "read_bytes": F.sum(F.when(read, F.col("result_bytes"))).over(of("path")), "first_read": F.row_number().over(of("path").orderBy(F.coalesce(read, F.lit(False)).desc(), "ord")) == 1,
            "truncated_here": count(F.col("truncated"), "path"), "same_command": count(F.col("command").isNotNull(), "command"), "same_error": count(F.col("signature").isNotNull(), "signature"),
            "agent_calls": count(call, "agent_id"), "agent_rows": F.count("*").over(of("agent_id")), "agent_last": F.row_number().over(of("agent_id").orderBy(F.col("ord").desc())) == 1,
            "agent_mech": count(call & (F.col("output_tokens") < 200) & (F.col("thinking") == 0), "agent_id"), "in_message": count(call, "message_id"), "tool_calls": count(call, "tool"),
            "tool_rank": F.row_number().over(of("tool").orderBy("duration_ms", "ord")), "first_main": F.row_number().over(of("main").orderBy("ord")) == 1,
            "gap": F.col("start_ms") - F.lag("start_ms").over(of("main").orderBy("ord")),
            "answer_ms": F.when(F.lag("event_type").over(of().orderBy("ord")) == "signup", F.col("start_ms") - F.lag("start_ms").over(of().orderBy("ord"))), "after_ms": F.col("start_ms") - F.lag("start_ms").over(of().orderBy("ord")),
            "read_before": F.last(F.when(read & ~F.col("is_error"), F.col("result_bytes")), ignorenulls=True).over(of("agent_id", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)),
            "break": F.sum(F.when(read & (F.col("tool").isNotNull()), 0).otherwise(1)).over(of("main", "turn_index").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    df = df.withColumn("run", F.when(F.col("main") & read, count(read, "main", "turn_index", "break")))
    # What a call and an agent add to the time that calls before it, or agents before it, have covered; a turn's length at its first record.
    end, own = F.col("start_ms") + F.col("duration_ms"), F.col("main") & call & ~F.coalesce(F.col("tool").isin("Task", "Agent"), F.lit(False))
    agent_first = F.col("agent_id").isNotNull() & (F.row_number().over(of("agent_id").orderBy("ord")) == 1)
    df = df.withColumns({"tool_end": F.when(own, end), "agent_from": F.when(agent_first, F.min("start_ms").over(of("agent_id"))), "agent_to": F.when(agent_first, F.max(end).over(of("agent_id"))),
                         "turn_ms": F.when((F.col("turn_index") >= 0) & (F.row_number().over(of("turn_index").orderBy("ord")) == 1), F.max(end).over(of("turn_index")) - F.min("start_ms").over(of("turn_index")))})
    covers = lambda a, z, *order: F.greatest(F.lit(0), F.col(z) - F.greatest(F.col(a), F.coalesce(F.max(z).over(of().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.col(a))))
    df = df.withColumns({"tool_adds": F.when(own, covers("start_ms", "tool_end", "start_ms", "ord")), "agent_adds": F.when(F.col("agent_from").isNotNull(), covers("agent_from", "agent_to", "agent_from", "ord"))})
    again = F.when(F.col("first_read") & (F.col("reads") > 1), F.col("reads") - 1)
    return df.withColumn("again", again).withColumn("again_rank", F.row_number().over(of().orderBy(F.col("again").desc_nulls_last(), "path", "ord")))


ANNOTATED = BOUND + """,
a0 AS (SELECT *, CASE WHEN command IN ('npm test') THEN 'test' WHEN command = 'make' THEN 'build' WHEN command IS NOT NULL THEN 'none' END AS class,
  count(CASE WHEN tool = 'Read' THEN 1 END) OVER p AS reads, sum(CASE WHEN tool = 'Read' THEN result_bytes END) OVER p AS read_bytes, row_number() OVER (PARTITION BY session_id, path ORDER BY coalesce(tool = 'Read', false) DESC, ord) = 1 AS first_read,
  count(CASE WHEN truncated THEN 1 END) OVER p AS truncated_here, count(command) OVER (PARTITION BY session_id, command) AS same_command, count(signature) OVER (PARTITION BY session_id, signature) AS same_error,
  count(tool) OVER ag AS agent_calls, count(*) OVER ag AS agent_rows, row_number() OVER (PARTITION BY session_id, agent_id ORDER BY ord DESC) = 1 AS agent_last,
  count(CASE WHEN tool IS NOT NULL AND output_tokens < 200 AND thinking = 0 THEN 1 END) OVER ag AS agent_mech, count(tool) OVER (PARTITION BY session_id, message_id) AS in_message, count(tool) OVER (PARTITION BY session_id, tool) AS tool_calls,
  row_number() OVER (PARTITION BY session_id, tool ORDER BY duration_ms, ord) AS tool_rank, row_number() OVER (PARTITION BY session_id, main ORDER BY ord) = 1 AS first_main,
  start_ms - lag(start_ms) OVER (PARTITION BY session_id, main ORDER BY ord) AS gap, CASE WHEN lag(event_type) OVER s = 'signup' THEN start_ms - lag(start_ms) OVER s END AS answer_ms, start_ms - lag(start_ms) OVER s AS after_ms,
  last_value(CASE WHEN tool = 'Read' AND NOT is_error THEN result_bytes END IGNORE NULLS) OVER (PARTITION BY session_id, agent_id, path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS read_before,
  sum(CASE WHEN tool = 'Read' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, main, turn_index ORDER BY ord ROWS UNBOUNDED PRECEDING) AS brk
  FROM b WINDOW p AS (PARTITION BY session_id, path), ag AS (PARTITION BY session_id, agent_id), s AS (PARTITION BY session_id ORDER BY ord)),
a0b AS (SELECT *, CASE WHEN main AND tool IS NOT NULL THEN start_ms + duration_ms END AS tool_end, CASE WHEN ag1 THEN min(start_ms) OVER ag END AS agent_from, CASE WHEN ag1 THEN max(start_ms + duration_ms) OVER ag END AS agent_to,
  CASE WHEN turn_index >= 0 AND row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ord) = 1 THEN max(start_ms + duration_ms) OVER tn - min(start_ms) OVER tn END AS turn_ms
  FROM (SELECT *, agent_id IS NOT NULL AND row_number() OVER (PARTITION BY session_id, agent_id ORDER BY ord) = 1 AS ag1 FROM a0) WINDOW ag AS (PARTITION BY session_id, agent_id), tn AS (PARTITION BY session_id, turn_index)),
a0c AS (SELECT *, greatest(0, tool_end - greatest(start_ms, coalesce(max(tool_end) OVER (PARTITION BY session_id ORDER BY start_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms))) AS tool_adds,
  CASE WHEN ag1 THEN greatest(0, agent_to - greatest(agent_from, coalesce(max(agent_to) OVER (PARTITION BY session_id ORDER BY agent_from, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), agent_from))) END AS agent_adds FROM a0b),
a1 AS (SELECT *, CASE WHEN main AND tool = 'Read' THEN count(CASE WHEN tool = 'Read' THEN 1 END) OVER (PARTITION BY session_id, main, turn_index, brk) END AS run, CASE WHEN first_read AND reads > 1 THEN reads - 1 END AS again FROM a0c),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY again DESC NULLS LAST, path, ord) AS again_rank FROM a1)"""


def facts(a: DataFrame) -> DataFrame:
    """One row per session."""
    n = lambda cond: F.count(F.when(cond, 1))
    total = lambda value, cond=None: F.coalesce(F.sum(value if cond is None else F.when(cond, value)), F.lit(0)).cast("long")
    most = lambda value, cond=None: F.coalesce(F.max(value if cond is None else F.when(cond, value)), F.lit(0)).cast("long")
    c = F.col
    call, main, agent = c("tool").isNotNull(), c("main"), c("agent_id").isNotNull()
    top = lambda k: c("again").isNotNull() & (c("again_rank") <= k)
    return a.groupBy("session_id").agg(
        total(F.expr(TOTAL)).alias("used"), n(call).alias("calls"), n(main).alias("requests"), n(c("is_error")).alias("errors"), total(F.floor(c("result_bytes") / 4), c("is_error")).alias("error_tokens"), most(c("same_error")).alias("top_error"),
        most(c("again"), top(10)).alias("most_again"), total(c("again"), top(10)).alias("again_10"), total(F.floor(c("read_bytes") * c("again") / c("reads") / 4), top(5)).alias("again_tokens"),
        most(c("same_command")).alias("top_command"), n(call & (c("result_bytes") >= 40_000)).alias("large_results"), total(c("result_bytes"), call & (c("result_bytes") >= 40_000)).alias("large_bytes"),
        total(F.floor(c("result_bytes") / 4), call & main & (c("result_bytes") >= 40_000)).alias("large_tokens"), n(c("run") >= 4).alias("run_calls"), total(c("duration_ms"), c("run") >= 4).alias("run_ms"),
        n(c("compaction")).alias("compactions"), most(c("context"), main).alias("peak"), most(c("context"), main & c("first_main")).alias("baseline"), total(c("cached"), main).alias("cached"), total(c("fresh"), main).alias("fresh"),
        total(c("after_ms"), c("event_type") == "signup").alias("wait_ms"), (F.max("start_ms") - F.min("start_ms")).alias("wall_ms"), F.count_distinct("agent_id").alias("agents"), n(agent & c("agent_last") & (c("agent_calls") == 0) & (c("agent_rows") <= 2)).alias("idle_agents"),
        n(c("hook") & c("is_error")).alias("hook_errors"), total(c("duration_ms"), c("hook")).alias("hook_ms"), total(c("turn_ms")).alias("active_ms"), total(c("tool_adds"), c("tool_end").isNotNull()).alias("tool_ms"), total(c("agent_adds")).alias("agent_ms"), n(c("interrupt")).alias("interrupts"), n(c("correction")).alias("corrections"), n(c("api_error")).alias("api_errors"),
        n(c("fallback")).alias("fallbacks"), n((c("tool") == "Edit") & (c("input_bytes") >= 20_000)).alias("large_writes"), total(F.floor(c("input_bytes") / 4), (c("tool") == "Edit") & (c("input_bytes") >= 20_000)).alias("write_tokens"),
        core.nearest_rank("answer_ms", 0.95).alias("answer_p95"), n(c("event_type") == "signup").alias("turns"), n(c("unresolved")).alias("unresolved"), F.max_by("is_error", F.when(main & (c("class") == "test"), c("ord"))).alias("test_failed"),
        n((c("tool") == "Edit")).alias("edits"), n(c("class").isin("test", "build")).alias("checks"), n(~F.coalesce(c("tool").isin("Task", "Agent"), F.lit(False)) & call & (c("tool_calls") >= 5) & (c("tool_rank") == F.ceil(c("tool_calls") * 95 / 100)) & (c("duration_ms") > 30_000)).alias("slow_tools"),
        n(agent & c("agent_last") & c("is_error")).alias("failed_agents"), most(c("depth")).alias("depth"), n(c("miss") > 0).alias("misses"), most(c("miss")).alias("most_missed"), total(c("miss")).alias("missed"), total(c("wrote"), main).alias("wrote"), total(c("wrote_1h"), main).alias("wrote_1h"),
        n(main & (c("gap") >= 0)).alias("gaps"), core.nearest_rank("case when main and gap >= 0 then gap end", 0.5).alias("gap_median"), n(c("truncated")).alias("truncated"), most(c("truncated_here")).alias("truncated_same"), total(c("attached"), c("attached") > 500_000).alias("attached_bytes"),
        n(c("queued")).alias("queued"), total(c("thinking"), (c("thinking") > 2000) & (c("in_message") == 1) & call).alias("thinking"), n(c("burst") > 8000).alias("bursts"), n((c("burst") > 8000) & (c("tool") == "Edit")).alias("write_bursts"),
        n(agent & c("agent_last") & (c("agent_mech") >= 10) & (c("agent_mech") >= 0.6 * c("agent_calls"))).alias("mechanical"), n((c("tool") == "Edit") & (c("read_before") >= 1000) & c("input_bytes").between(c("read_before") * 0.7, c("read_before") * 1.3)).alias("rewrites"),
        total(F.floor(c("input_bytes") / 4), (c("tool") == "Edit") & (c("read_before") >= 1000) & c("input_bytes").between(c("read_before") * 0.7, c("read_before") * 1.3)).alias("rewrite_tokens"),
    )


FACTS = ANNOTATED + f""",
f0 AS (SELECT session_id, sum({TOTAL})::BIGINT AS used, count(tool) AS calls, count(CASE WHEN main THEN 1 END) AS requests, count(CASE WHEN is_error THEN 1 END) AS errors, coalesce(sum(CASE WHEN is_error THEN result_bytes // 4 END), 0)::BIGINT AS error_tokens, coalesce(max(same_error), 0) AS top_error,
  coalesce(max(CASE WHEN again_rank <= 10 THEN again END), 0) AS most_again, coalesce(sum(CASE WHEN again_rank <= 10 THEN again END), 0)::BIGINT AS again_10, coalesce(sum(CASE WHEN again_rank <= 5 AND again IS NOT NULL THEN floor(read_bytes::DOUBLE * again / reads / 4) END), 0)::BIGINT AS again_tokens,
  coalesce(max(same_command), 0) AS top_command, count(CASE WHEN tool IS NOT NULL AND result_bytes >= 40000 THEN 1 END) AS large_results, coalesce(sum(CASE WHEN tool IS NOT NULL AND result_bytes >= 40000 THEN result_bytes END), 0)::BIGINT AS large_bytes,
  coalesce(sum(CASE WHEN tool IS NOT NULL AND main AND result_bytes >= 40000 THEN result_bytes // 4 END), 0)::BIGINT AS large_tokens, count(CASE WHEN run >= 4 THEN 1 END) AS run_calls, coalesce(sum(CASE WHEN run >= 4 THEN duration_ms END), 0)::BIGINT AS run_ms,
  count(CASE WHEN compaction THEN 1 END) AS compactions, coalesce(max(CASE WHEN main THEN context END), 0) AS peak, coalesce(max(CASE WHEN main AND first_main THEN context END), 0) AS baseline, coalesce(sum(CASE WHEN main THEN cached END), 0)::BIGINT AS cached, coalesce(sum(CASE WHEN main THEN fresh END), 0)::BIGINT AS fresh,
  coalesce(sum(CASE WHEN event_type = 'signup' THEN after_ms END), 0)::BIGINT AS wait_ms, max(start_ms) - min(start_ms) AS wall_ms, count(DISTINCT agent_id) AS agents, count(CASE WHEN NOT main AND agent_last AND agent_calls = 0 AND agent_rows <= 2 THEN 1 END) AS idle_agents,
  count(CASE WHEN hook AND is_error THEN 1 END) AS hook_errors, coalesce(sum(CASE WHEN hook THEN duration_ms END), 0)::BIGINT AS hook_ms, coalesce(sum(turn_ms), 0)::BIGINT AS active_ms, coalesce(sum(CASE WHEN tool_end IS NOT NULL THEN tool_adds END), 0)::BIGINT AS tool_ms, coalesce(sum(agent_adds), 0)::BIGINT AS agent_ms, count(CASE WHEN interrupt THEN 1 END) AS interrupts, count(CASE WHEN correction THEN 1 END) AS corrections,
  count(CASE WHEN api_error THEN 1 END) AS api_errors, count(CASE WHEN fallback THEN 1 END) AS fallbacks, count(CASE WHEN tool = 'Edit' AND input_bytes >= 20000 THEN 1 END) AS large_writes, coalesce(sum(CASE WHEN tool = 'Edit' AND input_bytes >= 20000 THEN input_bytes // 4 END), 0)::BIGINT AS write_tokens,
  quantile_disc(answer_ms, 0.95) AS answer_p95, count(CASE WHEN event_type = 'signup' THEN 1 END) AS turns, count(CASE WHEN unresolved THEN 1 END) AS unresolved, arg_max(is_error, CASE WHEN main AND class = 'test' THEN ord END) AS test_failed,
  count(CASE WHEN tool = 'Edit' THEN 1 END) AS edits, count(CASE WHEN class IN ('test', 'build') THEN 1 END) AS checks, count(CASE WHEN tool IS NOT NULL AND tool_calls >= 5 AND tool_rank = ceil(tool_calls * 95 / 100) AND duration_ms > 30000 THEN 1 END) AS slow_tools,
  count(CASE WHEN NOT main AND agent_last AND is_error THEN 1 END) AS failed_agents, coalesce(max(depth), 0) AS depth, count(CASE WHEN miss > 0 THEN 1 END) AS misses, coalesce(max(miss), 0) AS most_missed, coalesce(sum(miss), 0)::BIGINT AS missed,
  coalesce(sum(CASE WHEN main THEN wrote END), 0)::BIGINT AS wrote, coalesce(sum(CASE WHEN main THEN wrote_1h END), 0)::BIGINT AS wrote_1h, count(CASE WHEN main AND gap >= 0 THEN 1 END) AS gaps, quantile_disc(CASE WHEN main AND gap >= 0 THEN gap END, 0.5) AS gap_median,
  count(CASE WHEN truncated THEN 1 END) AS truncated, coalesce(max(truncated_here), 0) AS truncated_same, coalesce(sum(CASE WHEN attached > 500000 THEN attached END), 0)::BIGINT AS attached_bytes, count(CASE WHEN queued THEN 1 END) AS queued,
  coalesce(sum(CASE WHEN thinking > 2000 AND in_message = 1 AND tool IS NOT NULL THEN thinking END), 0)::BIGINT AS thinking, count(CASE WHEN burst > 8000 THEN 1 END) AS bursts, count(CASE WHEN burst > 8000 AND tool = 'Edit' THEN 1 END) AS write_bursts,
  count(CASE WHEN NOT main AND agent_last AND agent_mech >= 10 AND agent_mech >= 0.6 * agent_calls THEN 1 END) AS mechanical, count(CASE WHEN tool = 'Edit' AND read_before >= 1000 AND input_bytes BETWEEN read_before * 0.7 AND read_before * 1.3 THEN 1 END) AS rewrites,
  coalesce(sum(CASE WHEN tool = 'Edit' AND read_before >= 1000 AND input_bytes BETWEEN read_before * 0.7 AND read_before * 1.3 THEN input_bytes // 4 END), 0)::BIGINT AS rewrite_tokens FROM a GROUP BY session_id)"""


def _rule(name: str, fires: str, severity: str | int, saving: str = "0") -> None:
    RULES[name] = lambda: (F.expr(fires), F.expr(str(severity)), F.expr(saving))


# The thresholds. E1 and on, in the order of the inventory.
_rule("reread-files", "most_again >= 2", "case when again_10 >= 10 then 3 when again_10 >= 5 then 2 else 1 end", "again_tokens * (1 + greatest(1, requests / 2))")
_rule("repeated-commands", "top_command >= 4", "case when top_command >= 8 then 2 else 1 end")
_rule("tool-errors", "errors > 0 and (errors >= 0.1 * calls or top_error >= 3)", "case when errors >= 0.2 * calls or top_error >= 6 then 3 else 2 end", "error_tokens")
_rule("oversized-tool-results", "large_results > 0", "case when large_bytes > 400000 then 3 when large_bytes > 150000 then 2 else 1 end", "large_tokens * (1 + greatest(1, requests / 3))")
_rule("sequential-reads", "run_calls > 0", "case when run_calls >= 20 then 2 else 1 end")
_rule("compactions", "compactions > 0", "least(compactions, 3)")
_rule("context-near-limit", "compactions = 0 and peak > 0.7 * 200000", 2)
_rule("preamble-weight", "baseline >= 25000 and requests >= 5", "case when baseline > 60000 then 2 else 1 end", "0.3 * baseline * requests")
_rule("low-cache-hit", "requests >= 8 and cached < 0.6 * (cached + fresh)", "case when cached < 0.4 * (cached + fresh) then 3 else 2 end")
_rule("human-wait-dominates", "wall_ms >= 600000 and wait_ms >= 0.5 * wall_ms", 0)
_rule("agent-fanout", "agents > 0", 0)
_rule("idle-agents", "idle_agents > 0", 1)
_rule("hook-errors", "hook_errors > 0", "case when hook_errors >= 5 then 2 else 1 end")
_rule("hook-latency", "hook_ms > 60000 or hook_ms > 0.05 * active_ms", 1)
_rule("interruptions", "interrupts >= 2", "case when interrupts >= 4 then 2 else 1 end")
_rule("user-corrections", "corrections >= 2", "case when corrections >= 4 then 3 else 2 end")
_rule("api-errors", "api_errors > 0", "case when api_errors >= 5 then 2 else 1 end")
_rule("model-fallback", "fallbacks > 0", 2)
_rule("large-writes", "large_writes > 0", "case when write_tokens > 40000 then 2 else 1 end", "0.5 * write_tokens")
_rule("slow-first-response", "answer_p95 >= 30000 and turns >= 5", 1)
_rule("unresolved-tool-calls", "unresolved > 0", 1)
_rule("unverified-edits", "test_failed or (edits > 0 and checks = 0)", "case when test_failed then 3 else 2 end")
_rule("cache-dominates-tokens", "peak > 0 and cached >= 100 * peak", "case when used >= 750000000 then 3 else 0 end")
_rule("slow-tool", "slow_tools > 0", 1)
_rule("failed-agents", "failed_agents > 0", "case when failed_agents >= 2 then 2 else 1 end")
_rule("deep-fanout", "depth >= 3", 0)
_rule("time-budget", "active_ms >= 60000 and least(greatest(tool_ms, agent_ms), active_ms) >= 0.75 * active_ms", 0)
_rule("cache-invalidation", "misses > 0", "case when most_missed > 300000 or (misses > 3 and missed >= 50000) then 3 when most_missed >= 50000 or misses > 3 then 2 else 1 end")
_rule("cache-ttl-churn", "wrote >= 100000 and wrote_1h > 0.75 * wrote", "case when gaps >= 3 and gap_median < 300000 then 2 else 0 end")
_rule("truncated-reads", "truncated > 0", "case when truncated_same >= 2 then 2 else 1 end")
_rule("binary-attachments", "attached_bytes > 0", 2, "attached_bytes / 4")
_rule("queued-prompts", "queued >= 20", 0)
_rule("thinking-on-mechanical", "thinking > 0", 1, "thinking")
_rule("output-burst", "bursts >= 10", "case when write_bursts >= 3 then 1 else 0 end")
_rule("model-for-task", "mechanical > 0", 0)
_rule("write-not-edit", "rewrites >= 2", 1, "0.6 * rewrite_tokens")


def insights(f: DataFrame, rules: dict | None = None) -> DataFrame:
    """rule, session_id, severity, saving of every rule that fires; a rule that fails is a row of its own, without a session."""
    rows, failed = [], []
    for name, make in (rules or RULES).items():
        try:
            fires, severity, saving = make()
            one = F.struct(F.lit(name).alias("rule"), fires.cast("boolean").alias("fires"), severity.cast("int").alias("severity"), F.least(F.floor(saving).cast("long"), F.col("used")).alias("saving"))
            _ = f.select(one).schema
            rows.append(one)
        except Exception:  # whatever a rule of a user's own may raise
            failed.append(name)
    out = f.select("session_id", F.explode(F.array(*rows)).alias("x")).filter("x.fires").select("x.rule", "session_id", "x.severity", "x.saving")
    if failed:
        lost = f.sparkSession.createDataFrame([(f"rule-failed:{n}", None, INFO, 0) for n in failed], "rule string, session_id string, severity int, saving long")
        out = out.unionByName(lost)
    return out


def _events(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"))


def session_facts(events: DataFrame) -> DataFrame:
    return facts(annotated(bound_records(events)))


def session_insights(events: DataFrame) -> DataFrame:
    return insights(session_facts(events))


def insight_rollup(events: DataFrame) -> DataFrame:
    """Over all sessions: sessions, severities and savings of each rule, bounded by median times sessions."""
    x = session_insights(events)
    return x.groupBy("rule").agg(F.count("*").alias("sessions"), F.max("severity").alias("worst"), F.sum("saving").alias("claimed"), F.count(F.when(F.col("severity") == HIGH, 1)).alias("high"), core.nearest_rank("saving", 0.5).alias("median"))


# The rules once more, written for each as its condition, severity and saving in DuckDB's words.
_CASES = """
 ('reread-files', most_again > 1, if(again_10 > 9, 3, if(again_10 > 4, 2, 1)), again_tokens * (1 + greatest(1.0, requests / 2))),
 ('repeated-commands', top_command > 3, if(top_command > 7, 2, 1), 0),
 ('tool-errors', errors > 0 AND (errors * 10 >= calls OR top_error > 2), if(errors * 5 >= calls OR top_error > 5, 3, 2), error_tokens),
 ('oversized-tool-results', large_results > 0, if(large_bytes > 400000, 3, if(large_bytes > 150000, 2, 1)), large_tokens * (1 + greatest(1.0, requests / 3))),
 ('sequential-reads', run_calls > 0, if(run_calls > 19, 2, 1), 0),
 ('compactions', compactions > 0, if(compactions > 2, 3, compactions), 0),
 ('context-near-limit', compactions = 0 AND peak > 140000, 2, 0),
 ('preamble-weight', baseline >= 25000 AND requests >= 5, if(baseline > 60000, 2, 1), baseline * requests * 3 // 10),
 ('low-cache-hit', requests > 7 AND cached * 10 < 6 * (cached + fresh), if(cached * 10 < 4 * (cached + fresh), 3, 2), 0),
 ('human-wait-dominates', wall_ms >= 600000 AND wait_ms * 2 >= wall_ms, 0, 0),
 ('agent-fanout', agents > 0, 0, 0),
 ('idle-agents', idle_agents > 0, 1, 0),
 ('hook-errors', hook_errors > 0, if(hook_errors > 4, 2, 1), 0),
 ('hook-latency', hook_ms > 60000 OR hook_ms * 20 > active_ms, 1, 0),
 ('interruptions', interrupts > 1, if(interrupts > 3, 2, 1), 0),
 ('user-corrections', corrections > 1, if(corrections > 3, 3, 2), 0),
 ('api-errors', api_errors > 0, if(api_errors > 4, 2, 1), 0),
 ('model-fallback', fallbacks > 0, 2, 0),
 ('large-writes', large_writes > 0, if(write_tokens > 40000, 2, 1), write_tokens // 2),
 ('slow-first-response', answer_p95 >= 30000 AND turns > 4, 1, 0),
 ('unresolved-tool-calls', unresolved > 0, 1, 0),
 ('unverified-edits', coalesce(test_failed, false) OR (edits > 0 AND checks = 0), if(coalesce(test_failed, false), 3, 2), 0),
 ('cache-dominates-tokens', peak > 0 AND cached // peak >= 100, if(used >= 750000000, 3, 0), 0),
 ('slow-tool', slow_tools > 0, 1, 0),
 ('failed-agents', failed_agents > 0, if(failed_agents > 1, 2, 1), 0),
 ('deep-fanout', depth > 2, 0, 0),
 ('time-budget', active_ms >= 60000 AND greatest(tool_ms, agent_ms) * 4 >= 3 * active_ms, 0, 0),
 ('cache-invalidation', misses > 0, if(most_missed > 300000 OR (misses > 3 AND missed >= 50000), 3, if(most_missed >= 50000 OR misses > 3, 2, 1)), 0),
 ('cache-ttl-churn', wrote >= 100000 AND wrote_1h * 4 > 3 * wrote, if(gaps > 2 AND gap_median < 300000, 2, 0), 0),
 ('truncated-reads', truncated > 0, if(truncated_same > 1, 2, 1), 0),
 ('binary-attachments', attached_bytes > 0, 2, attached_bytes // 4),
 ('queued-prompts', queued > 19, 0, 0),
 ('thinking-on-mechanical', thinking > 0, 1, thinking),
 ('output-burst', bursts > 9, if(write_bursts > 2, 1, 0), 0),
 ('model-for-task', mechanical > 0, 0, 0),
 ('write-not-edit', rewrites > 1, 1, rewrite_tokens * 6 // 10)"""
_ROWS = ", ".join("row" + line.strip().rstrip(",") for line in _CASES.strip().split("\n"))
_FOUND = FACTS + f""",
found AS (SELECT x[1] AS rule, session_id, x[3]::INT AS severity, least(floor(x[4])::BIGINT, used) AS saving FROM (SELECT session_id, used, unnest([{_ROWS}]) AS x FROM f0) WHERE x[2])
"""

QUERIES = {"session_facts": _events(session_facts), "session_insights": _events(session_insights), "insight_rollup": _events(insight_rollup)}
ORACLE = {
    "session_facts": FACTS + " SELECT * FROM f0",
    "session_insights": _FOUND + "SELECT * FROM found",
    "insight_rollup": _FOUND + "SELECT rule, count(*) AS sessions, max(severity) AS worst, sum(saving)::BIGINT AS claimed, count(CASE WHEN severity = 3 THEN 1 END) AS high, quantile_disc(saving, 0.5) AS median FROM found GROUP BY rule",
}
