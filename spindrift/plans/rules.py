"""Threshold rules over session records. A rule is a function of the records to findings.

Findings have one shape: rule, session_id, severity (3 high, 2 medium, 1 low, 0 info), saving (tokens,
at most the session's total). ``@rule`` adds one to the registry; ``findings`` runs all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import core
from .session_queries import REC, TOTAL, flag

RULES: dict = {}
#: Rules with windows over a session's rows; they read records dealt out at so many rows a task. The others sum in the task that reads.
IN_ORDER = ("sequential-reads", "human-wait-dominates", "write-not-read", "long-gap")
#: The thresholds.
ERRORS_MANY, ERROR_RATE, BYTES_LARGE, BIG_RESULTS, READS_IN_ROW, CONTEXT_NEAR, GAP_SHARE, AGENTS_MANY, WRITES_LARGE, RETRIES = 3, 0.25, 90_000, 2, 3, 10_500, 0.5, 3, 90_000, 2


def rule(name: str):
    def register(f):
        RULES[name] = f
        return f

    return register


def _finding(df: DataFrame, severity, saving) -> DataFrame:
    return df.select("session_id", severity.cast("int").alias("severity"), saving.cast("long").alias("saving"))


@rule("tool-errors")
def tool_errors(rec: DataFrame) -> DataFrame:
    s = rec.groupBy("session_id").agg(F.count("tool").alias("calls"), flag(F.col("is_error")).alias("errors"), F.sum(F.when(F.col("is_error"), F.col("output_tokens")).otherwise(0)).alias("n"))
    many = s.filter((F.col("errors") >= ERRORS_MANY) & (F.col("errors") >= ERROR_RATE * F.col("calls")))
    return _finding(many, F.when(F.col("errors") * 2 >= F.col("calls"), 3).otherwise(2), F.col("n"))


@rule("oversized-results")
def oversized_results(rec: DataFrame) -> DataFrame:
    s = rec.filter(F.col("tool").isNotNull() & (F.col("result_bytes") >= BYTES_LARGE)).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("result_bytes") / 4)).alias("t"))
    return _finding(s.filter(F.col("n") >= BIG_RESULTS), F.lit(2), F.col("t"))


@rule("sequential-reads")
def sequential_reads(rec: DataFrame) -> DataFrame:
    runs = core.islands(rec.filter("tool is not null"), ["session_id"], ["ord"], F.col("tool") == "Read", READS_IN_ROW)
    return _finding(runs.groupBy("session_id").agg(F.sum(F.col("n") - 1).alias("n")), F.lit(1), F.col("n") * 100)


@rule("reread-files")
def reread_files(rec: DataFrame) -> DataFrame:
    c = rec.filter("tool = 'Read'").groupBy("session_id", "path", F.coalesce("agent_id", F.lit("main")).alias("context")).agg(F.count("*").alias("r"), F.sum("result_bytes").alias("b"))
    s = c.filter("r > 1").groupBy("session_id").agg(F.sum(F.floor(F.col("b") * (F.col("r") - 1) / F.col("r") / 4)).alias("t"))
    return _finding(s, F.lit(1), F.col("t"))


@rule("context-near-limit")
def context_near_limit(rec: DataFrame) -> DataFrame:
    s = rec.filter("agent_id is null").groupBy("session_id").agg(F.max(F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")).alias("peak"))
    return _finding(s.filter(F.col("peak") >= CONTEXT_NEAR), F.lit(2), F.lit(0))


@rule("unverified-edits")
def unverified_edits(rec: DataFrame) -> DataFrame:
    x = rec.groupBy("session_id").agg(F.max(F.when(F.col("tool") == "Edit", F.col("ord"))).alias("e"), F.max(F.when((F.col("tool") == "Bash") & ~F.col("is_error"), F.col("ord"))).alias("b"))
    return _finding(x.filter("e is not null and (b is null or b < e)"), F.lit(2), F.lit(0))


@rule("human-wait-dominates")
def human_wait_dominates(rec: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ord")
    gaps = rec.withColumn("g", F.when(F.col("event_type") == "signup", F.col("start_ms") - F.lag("start_ms").over(w)))
    s = gaps.groupBy("session_id").agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), (F.max("start_ms") - F.min("start_ms")).alias("wall"))
    return _finding(s.filter((F.col("wall") > 0) & (F.col("g") > GAP_SHARE * F.col("wall"))), F.lit(0), F.lit(0))


@rule("agent-fanout")
def agent_fanout(rec: DataFrame) -> DataFrame:
    s = rec.filter("agent_id is not null").groupBy("session_id").agg(F.countDistinct("agent_id").alias("n"))
    return _finding(s.filter(F.col("n") >= AGENTS_MANY), F.lit(0), F.lit(0))


@rule("large-writes")
def large_writes(rec: DataFrame) -> DataFrame:
    s = rec.filter((F.col("tool") == "Edit") & (F.col("result_bytes") >= WRITES_LARGE)).groupBy("session_id").agg(F.sum("output_tokens").alias("t"))
    return _finding(s, F.lit(1), F.col("t"))


@rule("repeated-errors")
def repeated_errors(rec: DataFrame) -> DataFrame:
    s = rec.filter("is_error").groupBy("session_id", "path").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("t")).filter(F.col("n") > RETRIES)
    return _finding(s.groupBy("session_id").agg(F.sum("t").alias("t")), F.lit(1), F.col("t"))


SLOW_MS, SLOW_CALLS, CACHE_SHARE, IDLE_CALLS, BURST_TOKENS, BURSTS, SCRIPT_RUNS, WAIT_MS = 90_000, 2, 0.9, 1, 12, 3, 3, 86_400_000


@rule("slow-tool")
def slow_tool(rec: DataFrame) -> DataFrame:
    s = rec.filter("tool is not null").groupBy("session_id", "tool").agg(F.count("*").alias("n"), core.nearest_rank("duration_ms", 0.95).alias("p"))
    return _finding(s.filter((F.col("n") >= SLOW_CALLS) & (F.col("p") >= SLOW_MS)).select("session_id").distinct(), F.lit(1), F.lit(0))


@rule("cache-dominates")
def cache_dominates(rec: DataFrame) -> DataFrame:
    s = rec.groupBy("session_id").agg(F.sum("cache_read").alias("c"), F.sum(F.expr(TOTAL)).alias("n"))
    return _finding(s.filter(F.col("c") > CACHE_SHARE * F.col("n")), F.lit(0), F.floor(F.col("c") / 10))


@rule("idle-agents")
def idle_agents(rec: DataFrame) -> DataFrame:
    s = rec.filter("agent_id is not null").groupBy("session_id", "agent_id").agg(F.count("tool").alias("n"), F.sum(F.expr(TOTAL)).alias("t"))
    return _finding(s.filter(F.col("n") <= IDLE_CALLS).groupBy("session_id").agg(F.sum("t").alias("t")), F.lit(1), F.col("t"))


@rule("output-burst")
def output_burst(rec: DataFrame) -> DataFrame:
    s = rec.filter(F.col("output_tokens") >= BURST_TOKENS).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("t"))
    return _finding(s.filter(F.col("n") >= BURSTS), F.lit(0), F.col("t"))


@rule("script-candidate")
def script_candidate(rec: DataFrame) -> DataFrame:
    s = rec.filter("tool = 'Bash'").groupBy("session_id", "path").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("t")).filter(F.col("n") >= SCRIPT_RUNS)
    return _finding(s.groupBy("session_id").agg(F.sum("t").alias("t")), F.lit(0), F.col("t"))


@rule("write-not-read")
def write_not_read(rec: DataFrame) -> DataFrame:
    """Edits of a file that the session had not read before."""
    w = Window.partitionBy("session_id", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    x = rec.filter("tool in ('Read', 'Edit')").withColumn("r", F.max(F.when(F.col("tool") == "Read", 1).otherwise(0)).over(w)).filter("tool = 'Edit' and coalesce(r, 0) = 0")
    return _finding(x.groupBy("session_id").agg(F.count("*").alias("n")), F.lit(1), F.lit(0))


@rule("long-gap")
def long_gap(rec: DataFrame) -> DataFrame:
    gap = F.col("start_ms") - F.lag("start_ms").over(Window.partitionBy("session_id").orderBy("ord"))
    s = rec.withColumn("gap", gap).groupBy("session_id").agg(F.max("gap").alias("gap"), F.sum("cache_write").alias("t"))
    return _finding(s.filter(F.col("gap") >= WAIT_MS), F.lit(0), F.col("t"))


@rule("model-for-task")
def model_for_task(rec: DataFrame) -> DataFrame:
    """Agents that only read, with more output than their reads call for."""
    s = rec.filter("agent_id is not null").groupBy("session_id", "agent_id").agg(F.count("tool").alias("n"), flag(F.col("tool") == "Read").alias("r"), F.sum("output_tokens").alias("t"))
    only = s.filter("n > 0 and n = r and t > 5 * n")
    return _finding(only.groupBy("session_id").agg(F.sum("t").alias("t")), F.lit(1), F.col("t"))


def findings(rec: DataFrame, rules: dict | None = None) -> DataFrame:
    """Findings of all rules; a saving is at most what the session used."""
    parts, in_order = None, core.dealt(rec, ["session_id"], rec.count())
    for name, f in (rules or RULES).items():
        part = f(in_order if name in IN_ORDER else rec).select(F.lit(name).alias("rule"), "session_id", "severity", "saving")
        parts = part if parts is None else parts.unionByName(part)
    used = rec.groupBy("session_id").agg(F.sum(F.expr(TOTAL)).alias("used"))
    return parts.join(used, "session_id").select("rule", "session_id", "severity", F.least("saving", "used").alias("saving"))


FINDINGS_SQL = REC + f""", total AS (SELECT session_id, sum({TOTAL})::BIGINT AS used FROM rec GROUP BY 1),
seq AS (SELECT session_id, ord, tool = 'Read' AS f, sum(CASE WHEN tool = 'Read' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM rec WHERE tool IS NOT NULL),
raw AS (
 SELECT 'tool-errors' AS rule, session_id, CASE WHEN 2 * sum(is_error::INT) >= count(tool) THEN 3 ELSE 2 END AS severity, sum(CASE WHEN is_error THEN output_tokens ELSE 0 END)::BIGINT AS saving FROM rec GROUP BY session_id HAVING sum(is_error::INT) >= {ERRORS_MANY} AND sum(is_error::INT) >= {ERROR_RATE} * count(tool)
 UNION ALL SELECT 'oversized-results', session_id, 2, sum(result_bytes // 4)::BIGINT FROM rec WHERE tool IS NOT NULL AND result_bytes >= {BYTES_LARGE} GROUP BY session_id HAVING count(*) >= {BIG_RESULTS}
 UNION ALL SELECT 'sequential-reads', session_id, 1, sum(n - 1)::BIGINT * 100 FROM (SELECT session_id, g, count(*) AS n FROM seq WHERE f GROUP BY ALL HAVING count(*) >= {READS_IN_ROW}) GROUP BY session_id
 UNION ALL SELECT 'reread-files', session_id, 1, sum(floor(b * (r - 1) / r / 4))::BIGINT FROM (SELECT session_id, path, coalesce(agent_id, 'main') AS c, count(*) AS r, sum(result_bytes)::DOUBLE AS b FROM rec WHERE tool = 'Read' GROUP BY ALL HAVING count(*) > 1) GROUP BY session_id
 UNION ALL SELECT 'context-near-limit', session_id, 2, 0 FROM rec WHERE agent_id IS NULL GROUP BY session_id HAVING max(input_tokens + cache_read + cache_write) >= {CONTEXT_NEAR}
 UNION ALL SELECT 'unverified-edits', session_id, 2, 0 FROM (SELECT session_id, max(CASE WHEN tool = 'Edit' THEN ord END) AS e, max(CASE WHEN tool = 'Bash' AND NOT is_error THEN ord END) AS b FROM rec GROUP BY 1) WHERE e IS NOT NULL AND (b IS NULL OR b < e)
 UNION ALL SELECT 'human-wait-dominates', session_id, 0, 0 FROM (SELECT session_id, coalesce(sum(g), 0) AS g, max(start_ms) - min(start_ms) AS wall FROM (SELECT *, CASE WHEN event_type = 'signup' THEN start_ms - lag(start_ms) OVER (PARTITION BY session_id ORDER BY ord) END AS g FROM rec) GROUP BY 1) WHERE wall > 0 AND g > {GAP_SHARE} * wall
 UNION ALL SELECT 'agent-fanout', session_id, 0, 0 FROM rec WHERE agent_id IS NOT NULL GROUP BY session_id HAVING count(DISTINCT agent_id) >= {AGENTS_MANY}
 UNION ALL SELECT 'large-writes', session_id, 1, sum(output_tokens)::BIGINT FROM rec WHERE tool = 'Edit' AND result_bytes >= {WRITES_LARGE} GROUP BY session_id
 UNION ALL SELECT 'repeated-errors', session_id, 1, sum(t)::BIGINT FROM (SELECT session_id, path, sum(output_tokens) AS t FROM rec WHERE is_error GROUP BY ALL HAVING count(*) > {RETRIES}) GROUP BY session_id
 UNION ALL SELECT DISTINCT 'slow-tool', session_id, 1, 0 FROM (SELECT session_id, tool FROM rec WHERE tool IS NOT NULL GROUP BY ALL HAVING count(*) >= {SLOW_CALLS} AND quantile_disc(duration_ms, 0.95) >= {SLOW_MS})
 UNION ALL SELECT 'cache-dominates', session_id, 0, sum(cache_read)::BIGINT // 10 FROM rec GROUP BY session_id HAVING sum(cache_read) > {CACHE_SHARE} * sum({TOTAL})
 UNION ALL SELECT 'idle-agents', session_id, 1, sum(t)::BIGINT FROM (SELECT session_id, agent_id, sum({TOTAL}) AS t FROM rec WHERE agent_id IS NOT NULL GROUP BY ALL HAVING count(tool) <= {IDLE_CALLS}) GROUP BY session_id
 UNION ALL SELECT 'output-burst', session_id, 0, sum(output_tokens)::BIGINT FROM rec WHERE output_tokens >= {BURST_TOKENS} GROUP BY session_id HAVING count(*) >= {BURSTS}
 UNION ALL SELECT 'script-candidate', session_id, 0, sum(t)::BIGINT FROM (SELECT session_id, path, sum(output_tokens) AS t FROM rec WHERE tool = 'Bash' GROUP BY ALL HAVING count(*) >= {SCRIPT_RUNS}) GROUP BY session_id
 UNION ALL SELECT 'write-not-read', session_id, 1, 0 FROM (SELECT session_id, tool, max(CASE WHEN tool = 'Read' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM rec WHERE tool IN ('Read', 'Edit')) WHERE tool = 'Edit' AND coalesce(r, 0) = 0 GROUP BY session_id
 UNION ALL SELECT 'long-gap', session_id, 0, sum(cache_write)::BIGINT FROM (SELECT *, start_ms - lag(start_ms) OVER (PARTITION BY session_id ORDER BY ord) AS gap FROM rec) GROUP BY session_id HAVING max(gap) >= {WAIT_MS}
 UNION ALL SELECT 'model-for-task', session_id, 1, sum(t)::BIGINT FROM (SELECT session_id, agent_id, sum(output_tokens) AS t FROM rec WHERE agent_id IS NOT NULL GROUP BY ALL HAVING count(tool) > 0 AND count(tool) = sum((tool IS NOT DISTINCT FROM 'Read')::INT) AND sum(output_tokens) > 5 * count(tool)) GROUP BY session_id),
found AS (SELECT rule, session_id, severity, least(saving, used) AS saving FROM raw JOIN total USING (session_id))
"""


def cross_findings(rec: DataFrame) -> DataFrame:
    """Findings over sessions: worst severity, bounded saving, first sessions, example; ranked."""
    f = findings(rec)
    worst = f.groupBy("rule").agg(F.max("severity").alias("severity"))
    rolled = core.bounded_rollup(f, "rule", "session_id", "saving").join(worst, "rule")
    return rolled.withColumn("rank", F.row_number().over(Window.orderBy(F.col("severity").desc(), F.col("bounded").desc(), F.col("sessions").desc(), "rule")))  # one row a rule


CROSS_SQL = FINDINGS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY session_id) AS q FROM found),
five AS (SELECT rule, string_agg(session_id, ',' ORDER BY session_id) AS first_sessions, arg_max(session_id, (saving, -q)) AS example FROM r WHERE q <= 5 GROUP BY 1),
t AS (SELECT rule, count(*) AS sessions, sum(saving)::BIGINT AS claimed, floor(least(sum(saving)::DOUBLE, median(saving) * count(*)) + 0.5)::BIGINT AS bounded, max(severity) AS severity FROM found GROUP BY 1)
SELECT t.*, first_sessions, example, row_number() OVER (ORDER BY severity DESC, bounded DESC, sessions DESC, rule)::INT AS rank FROM t JOIN five USING (rule)"""


def top_findings(rec: DataFrame) -> DataFrame:
    """The three first findings of each session, by severity, saving and rule."""
    return core.top_k(findings(rec), ["session_id"], [F.col("severity").desc(), F.col("saving").desc(), "rule"], 3).select("session_id", "rank", "rule")


QUERIES = {"findings": findings, "cross_findings": cross_findings, "top_findings": top_findings}
ORACLE = {
    "findings": FINDINGS_SQL + "SELECT * FROM found",
    "cross_findings": CROSS_SQL,
    "top_findings": FINDINGS_SQL + "SELECT session_id, rank::INT AS rank, rule FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY severity DESC, saving DESC, rule) AS rank FROM found) WHERE rank <= 3",
}
