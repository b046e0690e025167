"""Threshold rules over one pass of the records."""

from pyspark.sql import functions as F

from spindrift.plans import insights

FACTS = {n: 0 for n in (
    "used calls requests errors error_tokens top_error most_again again_10 again_tokens top_command large_results large_bytes large_tokens run_calls run_ms compactions peak baseline cached fresh wait_ms wall_ms active_ms agent_ms agents idle_agents"
    " hook_errors hook_ms tool_ms interrupts corrections api_errors fallbacks large_writes write_tokens answer_p95 turns unresolved edits checks slow_tools failed_agents depth misses most_missed missed wrote wrote_1h gaps gap_median"
    " truncated truncated_same attached_bytes queued thinking bursts write_bursts mechanical rewrites rewrite_tokens"
).split()}


def fired(spark, rules=None, test_failed=None, **given):
    row = {"session_id": "s", "test_failed": test_failed, **FACTS, **given}
    schema = ", ".join(f"{k} {'string' if k == 'session_id' else 'boolean' if k == 'test_failed' else 'long'}" for k in row)
    return {r.rule: (r.severity, r.saving) for r in insights.insights(spark.createDataFrame([tuple(row.values())], schema), rules).collect()}


def test_thresholds(spark):
    assert fired(spark) == {}
    assert fired(spark, errors=1, calls=10, used=9, error_tokens=50) == {"tool-errors": (2, 9)}  # a saving is at most what was used
    assert fired(spark, errors=1, calls=11) == {} and fired(spark, errors=2, calls=10)["tool-errors"][0] == 3
    assert fired(spark, most_again=1, again_10=9) == {} and fired(spark, most_again=2, again_10=5)["reread-files"][0] == 2
    assert fired(spark, peak=140_000) == {} and "context-near-limit" in fired(spark, peak=140_001) and "context-near-limit" not in fired(spark, peak=140_001, compactions=1)
    assert fired(spark, edits=1) == {"unverified-edits": (2, 0)} and fired(spark, edits=1, checks=1) == {} and fired(spark, checks=1, test_failed=True) == {"unverified-edits": (3, 0)}
    assert fired(spark, requests=8, cached=59, fresh=41)["low-cache-hit"][0] == 2 and fired(spark, requests=7, cached=1, fresh=9) == {}
    assert fired(spark, queued=19) == {} and fired(spark, queued=20) == {"queued-prompts": (0, 0)}
    assert fired(spark, peak=1000, cached=99_999) == {} and fired(spark, peak=1000, cached=100_000) == {"cache-dominates-tokens": (0, 0)} and fired(spark, peak=1, cached=100, used=750_000_000)["cache-dominates-tokens"][0] == 3
    assert fired(spark, cached=10**9) == {}  # no context, nothing carried
    assert fired(spark, active_ms=59_999, tool_ms=59_999) == {} and fired(spark, active_ms=60_000, tool_ms=44_999, agent_ms=100) == {}
    assert fired(spark, active_ms=60_000, agent_ms=45_000) == {"time-budget": (0, 0)} and fired(spark, active_ms=60_000, tool_ms=99_000) == {"time-budget": (0, 0)}
    assert fired(spark, misses=4, missed=50_000, most_missed=20_000)["cache-invalidation"][0] == 3


def test_a_rule_that_fails_leaves_the_others(spark):
    def broken():
        raise RuntimeError("no such field")

    rules = {"broken": broken, "unknown": lambda: (F.col("nowhere") > 1, F.lit(1), F.lit(0)), "queued-prompts": insights.RULES["queued-prompts"]}
    assert set(fired(spark, rules, queued=30)) == {"rule-failed:broken", "rule-failed:unknown", "queued-prompts"}


def test_all_rules_read_the_events_once(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "view", 1.0, '{"k": 3}')], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    df = insights.QUERIES["session_insights"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and len(insights.RULES) >= 36
