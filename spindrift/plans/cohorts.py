"""Which sessions before and after a change are compared: a walk under a byte budget, with a reason for each session left out.

All changes go in one plan: candidates are joined to the changes of their workspace, dealt out by change and sorted, and a task walks them
in order with a few numbers as its state, so that no change's candidates are held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sessions a side at most, and at the first checkpoint; bytes a side reads, and of one session.
MOST, FIRST, SIDE_BYTES, SESSION_BYTES = 10, 3, 2_000_000, 300_000
REASONS = ("evidence-session", "budget-spent", "over-budget", "still-settling", "unreadable", "other-workspace", "spans-application", "lifecycle-session")
WALK = "change string, side string, place long, session string, started long, ended long, decision string, spent long, read long, complete boolean"


class Side:
    """The walk of one side. ``spent`` decides, ``read`` bounds the work: sessions that still settle are read but do not decide."""

    def __init__(self, most: int, side_bytes: int, session_bytes: int):
        self.most, self.side_bytes, self.session_bytes = most, side_bytes, session_bytes
        self.taken = self.spent = self.read = 0
        self.stopped = self.complete = False

    def decide(self, x: dict) -> str | None:
        """accepted or a reason; None where the walk has ended before."""
        if self.stopped or self.taken >= self.most:
            return None
        if x["excluded"]:
            return "evidence-session"
        free, left = self.side_bytes - self.spent, self.side_bytes - self.read
        if free < 1 or left < 1:
            self.stopped, self.complete = True, free < 1
            return "budget-spent"
        room = min(self.session_bytes, left)
        if x["bytes"] > room:
            if room == self.session_bytes:
                return "over-budget"
            # Complete only if the bytes that decide stop the side here, too.
            self.stopped, self.complete = True, room == min(self.session_bytes, free)
            return "budget-spent"
        self.read += x["bytes"]
        if x["settling"]:
            return "still-settling"
        self.spent += x["bytes"]
        for reason in ("unreadable", "other-workspace", "spans-application", "lifecycle-session"):
            if x[reason.replace("-", "_")]:
                return reason
        self.taken += 1
        self.complete = self.taken >= self.most
        return "accepted"


def select_cohorts(changes: DataFrame, sessions: DataFrame, most: int = MOST, side_bytes: int = SIDE_BYTES, session_bytes: int = SESSION_BYTES) -> DataFrame:
    """``WALK``: every session that a side looked at, in order, and what became of it.

    ``changes``: change, workspace, cut, own (sessions of its finding). ``sessions``: session, workspace, mtime, started, ended, bytes,
    settling, unreadable, other_workspace, lifecycle_session. The side before the cut goes from the newest back, the one after it forward;
    by last write, then by name. A session last written at the cut itself is on neither side.
    """
    x = sessions.join(changes, "workspace").filter("mtime <> cut")
    before = F.col("mtime") < F.col("cut")
    x = x.select(
        "change", F.when(before, "baseline").otherwise("later").alias("side"), F.when(before, -F.col("mtime")).otherwise(F.col("mtime")).alias("by"), "session", "started", "ended", "bytes", "settling", "unreadable", "other_workspace", "lifecycle_session",
        F.array_contains("own", F.col("session")).alias("excluded"), F.when(before, F.col("ended") > F.col("cut")).otherwise(F.col("started") <= F.col("cut")).alias("spans_application"),
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, side, place = None, None, 0
        names, types = [f.split()[0] for f in WALK.split(", ")], (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if (r["change"], r["side"]) != key:
                    key, side, place = (r["change"], r["side"]), Side(most, side_bytes, session_bytes), 0
                decision = side.decide(r)
                if decision is not None:
                    place += 1
                    rows.append((*key, place, r["session"], r["started"], r["ended"], decision, side.spent, side.read, side.complete))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return x.repartition("change", "side").sortWithinPartitions("change", "side", "by", "session").mapInArrow(walk, WALK)


def graded(walk: DataFrame, first: int = FIRST) -> DataFrame:
    """change, skipped sessions by reason, baseline, later_count, later_complete, first_waits, and the later sessions that are compared now.

    Until the later side is complete only its ``first`` sessions by start count; one that started before the last of those and still
    settles holds the checkpoint, and then only sessions before it count.
    """
    n = lambda c: F.count(F.when(c, 1))
    later, ok = F.col("side") == "later", F.col("decision") == "accepted"
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("started", "session"))))
    w = walk.groupBy("change").agg(
        *[n(F.col("decision") == r).alias(r.replace("-", "_")) for r in REASONS], names(~later & ok).alias("b"), names(later & ok).alias("l"), names(later & (F.col("decision") == "still-settling")).alias("s"), F.coalesce(F.bool_or(F.when(later, F.col("complete"))), F.lit(False)).alias("later_complete")
    )
    third = F.get("l", F.lit(first - 1))
    holds = F.when(F.col("later_complete") | third.isNull(), F.array().cast(w.schema["s"].dataType)).otherwise(F.filter("s", lambda x: x < third))
    w = w.withColumn("holds", holds)
    open_ = F.when(F.size("holds") > 0, F.slice(F.filter("l", lambda x: x["started"] < F.get("holds", F.lit(0))["started"]), 1, first)).otherwise(F.slice("l", 1, first))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["session"]), ",")
    return w.select("change", *[r.replace("-", "_") for r in REASONS], ids(F.col("b")).alias("baseline"), F.size("l").cast("long").alias("later_count"), "later_complete", (F.size("holds") > 0).alias("first_waits"), ids(F.when(F.col("later_complete"), F.col("l")).otherwise(open_)).alias("later"))


def bound_changes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Days of users as sessions of a workspace of twenty, and three changes of each workspace."""
    k, ms = F.get_json_object("props", "$.k").cast("long"), F.unix_millis(F.col("ts").cast("timestamp"))
    s = events.groupBy("user_id", F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.sum(k).alias("q"), F.min(ms).alias("started"), F.max(ms).alias("mtime"))
    q = F.col("q")
    s = s.select(
        F.concat(F.lit("u"), "user_id", F.lit("-"), "day").alias("session"), F.floor(F.col("user_id") / 20).cast("long").alias("workspace"), "mtime", "started", (F.col("mtime") + F.when(q % 17 == 0, 40_000_000_000).otherwise(0)).alias("ended"), (q * 1700).alias("bytes"),
        (q % 7 == 0).alias("settling"), (q % 11 == 0).alias("unreadable"), (F.col("user_id") % 20 == 3).alias("other_workspace"), (q % 13 == 5).alias("lifecycle_session"), "q",
    )
    span = s.groupBy("workspace").agg(F.min("mtime").alias("a"), F.max("mtime").alias("z"))
    cuts = span.select("workspace", F.explode(F.array(*[F.lit(c) for c in (1, 2, 3)])).alias("c"), "a", "z").withColumn("cut", F.col("a") + F.expr("(z - a) * c div 4"))
    own = s.groupBy("workspace", (F.col("q") % 5).cast("int").alias("c")).agg(F.collect_list("session").alias("own"))
    changes = cuts.join(own, ["workspace", "c"], "left").select(F.concat(F.lit("c"), "workspace", F.lit("-"), "c").alias("change"), "workspace", "cut", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    return changes, s.drop("q")


def cohort_walk(events: DataFrame) -> DataFrame:
    return select_cohorts(*bound_changes(events))


_SQL = f"""
WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y%m%d') AS day, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS q, min(epoch_us(ts) // 1000) AS started, max(epoch_us(ts) // 1000) AS mtime FROM events GROUP BY ALL),
s AS (SELECT concat('u', user_id, '-', day) AS session, user_id // 20 AS ws, mtime, started, mtime + CASE WHEN q % 17 = 0 THEN 40000000000 ELSE 0 END AS ended, q * 1700 AS bytes, q, user_id % 20 = 3 AS other FROM e),
ch AS (SELECT concat('c', ws, '-', c) AS change, ws, c, a + (z - a) * c // 4 AS cut FROM (SELECT ws, min(mtime) AS a, max(mtime) AS z FROM s GROUP BY 1), (VALUES (1), (2), (3)) v(c)),
x AS (SELECT change, CASE WHEN mtime < cut THEN 'baseline' ELSE 'later' END AS side, s.*, q % 5 = c AS own, CASE WHEN mtime < cut THEN ended > cut ELSE started <= cut END AS spans,
  row_number() OVER (PARTITION BY change, mtime < cut ORDER BY CASE WHEN mtime < cut THEN -mtime ELSE mtime END, session) AS i FROM s JOIN ch USING (ws) WHERE mtime <> cut),
y AS (SELECT *, CASE WHEN q % 11 = 0 THEN 'unreadable' WHEN other THEN 'other-workspace' WHEN spans THEN 'spans-application' WHEN q % 13 = 5 THEN 'lifecycle-session' ELSE 'accepted' END AS fate FROM x),
f AS (SELECT change, side, 0::BIGINT AS i, NULL::VARCHAR AS session, NULL::BIGINT AS started, NULL::BIGINT AS ended, '' AS decision, 0::BIGINT AS spent, 0::BIGINT AS rd, 0 AS taken, false AS complete FROM y GROUP BY change, side
 UNION ALL SELECT change, side, i, session, started, ended, d, spent + CASE WHEN d IN ('unreadable', 'other-workspace', 'spans-application', 'lifecycle-session', 'accepted') THEN bytes ELSE 0 END,
   rd + CASE WHEN d IN ('evidence-session', 'budget-spent', 'over-budget') THEN 0 ELSE bytes END, taken + CASE WHEN d = 'accepted' THEN 1 ELSE 0 END,
   CASE d WHEN 'budget-spent' THEN {SIDE_BYTES} - spent < 1 OR ({SIDE_BYTES} - rd >= 1 AND least({SESSION_BYTES}, {SIDE_BYTES} - rd) = least({SESSION_BYTES}, {SIDE_BYTES} - spent)) WHEN 'accepted' THEN taken + 1 >= {MOST} ELSE complete END
 FROM (SELECT y.change, y.side, y.i, y.session, y.started, y.ended, y.bytes, f.spent, f.rd, f.taken, f.complete,
   CASE WHEN own THEN 'evidence-session' WHEN {SIDE_BYTES} - f.spent < 1 OR {SIDE_BYTES} - f.rd < 1 THEN 'budget-spent' WHEN y.bytes > least({SESSION_BYTES}, {SIDE_BYTES} - f.rd) THEN CASE WHEN {SIDE_BYTES} - f.rd >= {SESSION_BYTES} THEN 'over-budget' ELSE 'budget-spent' END
     WHEN q % 7 = 0 THEN 'still-settling' ELSE fate END AS d
   FROM f JOIN y ON y.change = f.change AND y.side = f.side AND y.i = f.i + 1 WHERE f.decision <> 'budget-spent' AND f.taken < {MOST})),
walk AS (SELECT change, side, i AS place, session, started, ended, decision, spent, rd AS "read", complete FROM f WHERE i > 0)"""
_events = lambda f: lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"))
QUERIES = {"cohort_walk": _events(cohort_walk), "cohorts_graded": _events(lambda e: graded(cohort_walk(e)))}
ORACLE = {
    "cohort_walk": _SQL + " SELECT * FROM walk",
    "cohorts_graded": _SQL + f""",
a AS (SELECT *, row_number() OVER (PARTITION BY change, side, decision ORDER BY started, session) AS r FROM walk),
g AS (SELECT change, {", ".join(f"count(CASE WHEN decision = '{r}' THEN 1 END) AS {r.replace('-', '_')}" for r in REASONS)}, coalesce(bool_or(CASE WHEN side = 'later' THEN complete END), false) AS done, count(CASE WHEN side = 'later' AND decision = 'accepted' THEN 1 END) AS n,
  max(CASE WHEN side = 'later' AND decision = 'accepted' AND r = {FIRST} THEN started END) AS third, max(CASE WHEN side = 'later' AND decision = 'accepted' AND r = {FIRST} THEN session END) AS third_s FROM a GROUP BY change),
h AS (SELECT g.change AS change, min(w.started) AS hold FROM g JOIN walk w ON w.change = g.change AND side = 'later' AND decision = 'still-settling' AND NOT done AND n >= {FIRST} AND (w.started, w.session) < (third, third_s) GROUP BY 1)
SELECT g.change AS change, {", ".join(r.replace("-", "_") for r in REASONS)}, (SELECT coalesce(string_agg(session, ',' ORDER BY started, session), '') FROM a WHERE a.change = g.change AND side = 'baseline' AND decision = 'accepted') AS baseline, n AS later_count, done AS later_complete, hold IS NOT NULL AS first_waits,
 (SELECT coalesce(string_agg(session, ',' ORDER BY started, session), '') FROM a WHERE a.change = g.change AND side = 'later' AND decision = 'accepted' AND (done OR (r <= {FIRST} AND (hold IS NULL OR started < hold)))) AS later FROM g LEFT JOIN h ON h.change = g.change""",
}
