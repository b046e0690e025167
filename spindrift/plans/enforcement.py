"""Instructions over sessions: rules that did not hold, and notes that were followed by the same complaint.

A conversation is a session of the project ``conv_id % 5`` and begins at ``conv_id`` thousand; a turn is a point behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core
from .shell_queries import ORACLE as SHELL_ORACLE
from .shell_queries import violations
from .table_queries import WORDS, _word_filter

#: Turns from a complaint to the note it leads to; share of the prompts that a rare word may be in, and their least number.
TRIGGER_TURNS, RARE_SHARE, RARE_LEAST, EXAMPLES = 3, 0.05, 3, 3


def rules_not_held(conversations: DataFrame) -> DataFrame:
    """Of each project, line and target that was broken: sessions that had it and that broke it, calls, calls that failed, the last session, the three with most calls."""
    v = violations(conversations).withColumn("project", F.col("session") % 5)
    key = ["project", "line", "target"]
    sums = v.groupBy(*key).agg(F.count("*").alias("in_context"), F.count(F.when(F.col("calls") > 0, 1)).alias("broken"), F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.max(F.when(F.col("calls") > 0, F.col("session"))).alias("last_broken"))
    top = core.top_k(v.filter("calls > 0"), key, [F.col("calls").desc(), "session"], EXAMPLES)
    named = top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("session").cast("string").alias("s")))), lambda x: x["s"]), ",").alias("examples"))
    return sums.filter("calls > 0").join(named, key)


def _at(session, turn):
    return session * 1000 + turn


def notes_and_complaints(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompts, complaints among them (project, session, turn, at, words) and note writes (project, path, session, turn, at, words)."""
    c = conversations.filter("conv_id is not null and turn is not null").select("role", (F.col("conv_id") % 5).alias("project"), F.col("conv_id").alias("session"), "turn", _at(F.col("conv_id"), F.col("turn")).alias("at"), tx.content_words(F.col("text"), 1 << 20).alias("words"))
    prompts = c.filter("role = 'user'").drop("role")
    writes = c.filter("role = 'assistant' and session % 3 = 1 and turn = 3").withColumn("path", F.concat(F.when(F.col("session") % 2 == 0, "notes/feedback_").otherwise("notes/topic_"), F.col("session") % 4, F.lit(".md"))).drop("role")
    return prompts, prompts.filter((F.col("session") + F.col("turn")) % 4 == 2), writes


def notes_not_held(conversations: DataFrame) -> DataFrame:
    """Of each note that a complaint led to, or that is named as feedback: sessions and complaints after it, and complaints that share its rare words.

    A note's trigger is the last complaint of its session up to three turns before its first write. Its topic is the rare words of all its writes and
    of its trigger. A later complaint of the project matches with one of them, with two where there was no trigger. Rare words are in at most
    5 % of the prompts, or in three, so that a word joins few notes with few complaints.
    """
    prompts, complaints, writes = notes_and_complaints(conversations)
    note = ["project", "path"]
    first = writes.groupBy(*note).agg(F.min(F.struct("at", "session", "turn")).alias("f"), F.count("*").alias("writes")).select(*note, "f.at", "f.session", "f.turn", "writes")
    led = core.asof_join(first.select(*note, "session", "at"), complaints.select("session", F.col("at").alias("c_at"), F.col("turn").alias("trigger")), ["session"], "at", "c_at", ["c_at", "trigger"])
    led = led.withColumn("near", F.col("c_at") >= F.col("at") - TRIGGER_TURNS).select(*note, F.when(F.col("near"), F.col("trigger")).alias("trigger"), F.when(F.col("near"), F.col("c_at")).alias("c_at"))
    first = first.join(led, note).filter(F.col("path").like("%feedback%") | F.col("trigger").isNotNull())
    df = prompts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    cap = prompts.agg(F.greatest(F.lit(RARE_LEAST), F.ceil(F.count("*") * F.lit(RARE_SHARE))).alias("cap"))
    common = df.join(F.broadcast(cap), F.col("df") > F.col("cap")).select("word")  # cap: one row
    about = first.select(*note).join(writes, note).select(*note, F.explode("words").alias("word")).unionByName(first.select(*note, F.col("c_at").alias("at")).join(complaints.drop("project"), "at").select(*note, F.explode("words").alias("word")))
    topic = about.distinct().join(common, "word", "left_anti").join(first.select(*note, "at", "trigger"), note)
    said = complaints.select("project", F.col("at").alias("c_at"), F.explode("words").alias("word")).join(common, "word", "left_anti")
    shared = topic.join(said, ["project", "word"]).filter("c_at > at")
    match = shared.groupBy(*note, "c_at", "trigger").agg(F.collect_list("word").alias("words")).filter(F.size("words") >= F.when(F.col("trigger").isNull(), 2).otherwise(1))
    counted = match.select(*note, F.explode("words").alias("word")).groupBy(*note, "word").agg(F.count("*").alias("m"))
    words = counted.groupBy(*note).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "word"))), lambda x: x["word"]), ",").alias("shared_words"))
    matches = match.groupBy(*note).agg(F.count("*").alias("matching"), F.min("c_at").alias("first_match"))
    shown = core.top_k(match, note, ["c_at"], EXAMPLES).groupBy(*note).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_at")), lambda x: x.cast("string")), ",").alias("examples"))
    # What comes after a write is the project's total less what came up to it: a running count and an as-of join, no pairs.
    after = first
    for rows, name in ((complaints.select("project", F.col("at").alias("t")), "complaints_after"), (prompts.select("project", "session").distinct().select("project", _at(F.col("session"), F.lit(0)).alias("t")), "sessions_after")):
        counts = core.running_index(rows, ["project"], ["t"], F.lit(True), "upto").withColumn("upto", F.col("upto") + 1)
        total = rows.groupBy("project").agg(F.count("*").alias("total"))
        after = core.asof_join(after, counts, ["project"], "at", "t", ["upto"]).join(total, "project", "left")
        after = after.withColumn(name, F.coalesce("total", F.lit(0)) - F.coalesce("upto", F.lit(0))).drop("total", "upto")
    out = after.join(matches, note, "left").join(words, note, "left").join(shown, note, "left")
    return out.select(*note, "session", "turn", "writes", "trigger", (F.col("sessions_after") + 1).alias("sessions_after"), "complaints_after", F.coalesce("matching", F.lit(0)).alias("matching"), (F.col("first_match") - F.col("at")).alias("first_match_after"), "shared_words", "examples")


_W = f"list_distinct(list_filter({WORDS}, lambda w: NOT list_contains({_word_filter()}, w)))"
QUERIES = {name: (lambda spark, sf_dir, f=f: f(spark.read.parquet(f"{sf_dir}/conversations.parquet"))) for name, f in (("rules_not_held", rules_not_held), ("notes_not_held", notes_not_held))}
ORACLE = {
    "rules_not_held": f"""WITH v AS (SELECT *, session % 5 AS project FROM ({SHELL_ORACLE['instruction_violations']})), b AS (SELECT *, row_number() OVER (PARTITION BY project, line, target ORDER BY calls DESC, session) AS r FROM v WHERE calls > 0)
SELECT project, line, target, count(*) AS in_context, count(CASE WHEN calls > 0 THEN 1 END) AS broken, sum(calls)::BIGINT AS calls, sum(failed)::BIGINT AS failed, max(CASE WHEN calls > 0 THEN session END) AS last_broken,
 (SELECT string_agg(session::VARCHAR, ',' ORDER BY r) FROM b WHERE b.project = v.project AND b.line = v.line AND b.target = v.target AND r <= 3) AS examples FROM v GROUP BY project, line, target HAVING sum(calls) > 0""",
    "notes_not_held": f"""
WITH c AS (SELECT role, conv_id % 5 AS project, conv_id AS session, turn, conv_id * 1000 + turn AS ms, {_W} AS ws FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT * FROM c WHERE role = 'user'), k AS (SELECT * FROM p WHERE (session + turn) % 4 = 2),
wr AS (SELECT *, concat(CASE WHEN session % 2 = 0 THEN 'notes/feedback_' ELSE 'notes/topic_' END, session % 4, '.md') AS path FROM c WHERE role = 'assistant' AND session % 3 = 1 AND turn = 3),
n0 AS (SELECT project, path, min(ms) AS ms, arg_min(session, ms) AS session, arg_min(turn, ms) AS turn, count(*) AS writes FROM wr GROUP BY ALL),
n1 AS (SELECT *, (SELECT max(k.turn) FROM k WHERE k.session = n0.session AND k.turn BETWEEN n0.turn - {TRIGGER_TURNS} AND n0.turn) AS trigger FROM n0), n AS (SELECT * FROM n1 WHERE path LIKE '%feedback%' OR trigger IS NOT NULL),
df AS (SELECT word, count(*) AS d FROM (SELECT unnest(ws) AS word FROM p) GROUP BY 1), common AS (SELECT word FROM df WHERE d > (SELECT greatest({RARE_LEAST}, ceil(count(*) * {RARE_SHARE})) FROM p)),
topic AS (SELECT DISTINCT project, path, word FROM (SELECT n.project, n.path, unnest(ws) AS word FROM n JOIN wr USING (project, path) UNION ALL SELECT n.project, n.path, unnest(ws) FROM n JOIN k ON k.session = n.session AND k.turn = n.trigger) WHERE word NOT IN (SELECT word FROM common)),
m AS (SELECT project, path, c_ms, trigger, list(word) AS ws FROM (SELECT n.project AS project, n.path AS path, k.ms AS c_ms, unnest(k.ws) AS word, n.trigger AS trigger FROM n JOIN k ON k.project = n.project AND k.ms > n.ms) JOIN topic USING (project, path, word) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY c_ms) AS r FROM m WHERE len(ws) >= CASE WHEN trigger IS NULL THEN 2 ELSE 1 END),
sw AS (SELECT project, path, string_agg(word, ',' ORDER BY q DESC, word) AS shared_words FROM (SELECT project, path, word, count(*) AS q FROM (SELECT project, path, unnest(ws) AS word FROM h) GROUP BY ALL) GROUP BY ALL)
SELECT n.project AS project, n.path AS path, session, turn, writes, trigger, 1 + (SELECT count(DISTINCT session) FROM p WHERE p.project = n.project AND p.session * 1000 > n.ms) AS sessions_after, (SELECT count(*) FROM k WHERE k.project = n.project AND k.ms > n.ms) AS complaints_after,
 (SELECT count(*) FROM h WHERE h.project = n.project AND h.path = n.path) AS matching, (SELECT min(c_ms) FROM h WHERE h.project = n.project AND h.path = n.path) - n.ms AS first_match_after, shared_words, (SELECT string_agg(c_ms::VARCHAR, ',' ORDER BY c_ms) FROM h WHERE h.project = n.project AND h.path = n.path AND r <= 3) AS examples
FROM n LEFT JOIN sw USING (project, path)""",
}
