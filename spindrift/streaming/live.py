"""Live facts of running sessions: open calls paired with their results, tasks, files, the last turns, kept as state.

State per session: open calls, tasks, files and links as maps, the last ``TURNS`` turns as a list, the rest as one row. A
batch's actions are taken in their order. A result closes its call; a prompt that starts a turn closes all that are open. A
task ends with its call's result, unless that says that it was launched and goes on: then with a notification that names a
status. A session that writes nothing for ``QUIET_MS`` by the watermark's clock gets one final row and gives up its state;
if it goes on after that, it begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.live import actions, live_lines
from .sessions import shared_folder

TURNS, QUIET_MS, DELAY = 10, 1_800_000, "1 hour"
FACTS = (
    "records long, turns long, last_prompt string, last_reply string, closed_calls long, closed_ms long, dropped_calls long, late_results long, ended_tasks long, branch string, error string, error_text string,"
    " last_turn_end long, context_tokens long, bad long, last_at long"
)
OUTPUT = f"session string, {FACTS}, open_calls string, question string, running_tasks string, files string, links string, history string, ended boolean"
_NAMES = [f.split()[0] for f in FACTS.split(", ")]
ZERO = {n: 0 for n in ("records", "turns", "closed_calls", "closed_ms", "dropped_calls", "late_results", "ended_tasks", "bad")}


class LiveFacts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", FACTS)
        self.open = handle.getMapState("open", "id string", "tool string, at long, ord long")
        self.tasks = handle.getMapState("tasks", "id string", "kind string, at long, launched boolean")
        self.files = handle.getMapState("files", "path string", "tool string, at long")
        self.links = handle.getMapState("links", "url string", "at long")
        self.history = handle.getListState("history", "prompt string, reply string, ended long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        f = dict(zip(_NAMES, self.facts.get())) if self.facts.exists() else {**dict.fromkeys(_NAMES), **ZERO}
        turns = [list(t) for t in self.history.get()] if self.history.exists() else []
        for a in sorted(rows, key=lambda r: r.ord):
            self._take(f, turns, a)
        self.facts.update(tuple(f[n] for n in _NAMES))
        if turns:  # a list state is never empty
            self.history.put([tuple(t) for t in turns[-TURNS:]])
        if f["last_at"] is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(f["last_at"] + QUIET_MS)
        yield self._row(key, f, turns[-TURNS:], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        f = dict(zip(_NAMES, self.facts.get()))
        yield self._row(key, f, [list(t) for t in self.history.get()] if self.history.exists() else [], True)
        for state in (self.facts, self.open, self.tasks, self.files, self.links, self.history):
            state.clear()

    def close(self) -> None:
        pass

    def _take(self, f: dict, turns: list, a: Row) -> None:
        f["records"] += 1
        if a.at is not None:
            f["last_at"] = max(a.at, f["last_at"] if f["last_at"] is not None else a.at)
        kind, one = a.kind, (a.id,)
        if kind == "call":
            self.open.updateValue(one, (a.tool, a.at, a.ord))
            if a.path is not None and a.at is not None:
                self.files.updateValue((a.path,), (a.tool, a.at))
            if a.status is not None:
                self.tasks.updateValue(one, (a.status, a.at, False))
        elif kind == "result":
            if not self.open.containsKey(one):
                f["late_results"] += 1
                return
            _, began, _ = self.open.getValue(one)
            f["closed_calls"] += 1
            if began is not None and a.at is not None and a.at >= began:
                f["closed_ms"] += a.at - began
            self.open.removeKey(one)
            if self.tasks.containsKey(one):
                if a.status == "launched":
                    self.tasks.updateValue(one, (*self.tasks.getValue(one)[:2], True))
                else:
                    self._end(f, one)
        elif kind == "notification":
            if a.status is not None and self.tasks.containsKey(one):
                self._end(f, one)
        elif kind == "prompt":
            for k in [tuple(k) for k in self.open.keys()]:
                f["dropped_calls"] += 1
                if self.tasks.containsKey(k):
                    self._end(f, k)
            self.open.clear()
            f["turns"] += 1
            f["error"] = f["error_text"] = None
            if a.text is not None:
                f["last_prompt"] = a.text
            turns.append([a.text, None, None])
        elif kind == "reply":
            f["last_reply"] = a.text
            if not turns:
                turns.append([None, None, None])
            turns[-1][1] = a.text
        elif kind == "turn-end":
            if a.at is not None:
                f["last_turn_end"] = a.at
                if turns:
                    turns[-1][2] = a.at
        elif kind == "clear":
            f["error"] = f["error_text"] = None
        elif kind == "error":
            f["error"], f["error_text"] = a.status, a.text
        elif kind == "context":
            f["context_tokens"] = a.tokens
        elif kind == "branch":
            f["branch"] = a.text
        elif kind == "pr":
            if not self.links.containsKey((a.text,)):
                self.links.updateValue((a.text,), (a.ord,))
        elif kind == "bad":
            f["bad"] += 1

    def _end(self, f: dict, key: tuple) -> None:
        self.tasks.removeKey(key)
        f["ended_tasks"] += 1

    def _row(self, key, f: dict, turns: list, ended: bool) -> Row:
        opened = sorted(((v[2], k[0], v[0]) for k, v in self.open.iterator()))
        asked = [i for _, i, tool in opened if tool == "AskUserQuestion"]
        files = sorted((v[1], k[0], v[0]) for k, v in self.files.iterator())
        return Row(
            session=key[0], **f, open_calls=",".join(i for _, i, _ in opened), question=asked[-1] if asked else None, running_tasks=",".join(sorted(k[0] for k in self.tasks.keys())),
            files=",".join(f"{p}:{tool}:{at}" for at, p, tool in files), links=",".join(k[0] for k, v in sorted(self.links.iterator(), key=lambda x: x[1][0])),
            history="|".join(f"{p if p is not None else '-'}>{'-' if r is None else len(r)}>{'-' if e is None else e}" for p, r, e in turns), ended=ended,
        )


def live_facts(stream: DataFrame) -> DataFrame:
    """A row of facts (``OUTPUT``) per session whenever it changes, and one with ``ended`` when it falls quiet.

    ``stream``: actions, with ``written``, the time (ms) at which the line was written: the clock of the watermark.
    """
    timed = stream.withColumn("ts", F.timestamp_millis("written")).withWatermark("ts", DELAY)
    return timed.groupBy("session").transformWithState(LiveFacts(), OUTPUT, "Update", "EventTime")


def landed_live(conversations: DataFrame, parts: int = 4) -> DataFrame:
    """Land transcript lines in the order of their times, stream them, and return each session's last facts."""
    spark = conversations.sparkSession
    root = shared_folder(spark)
    lines = live_lines(conversations)
    # The time by which a line and all before it in its session are written; before any time is known, the session's first.
    seconds = F.regexp_extract("line", r'"timestamp":(\d+)', 1).try_cast("long")
    ms = F.when(seconds <= 1_000_000_000_000, seconds * 1000).otherwise(seconds)
    rows = lines.withColumn("written", F.coalesce(F.max(ms).over(Window.partitionBy("session").orderBy("number")), F.min(ms).over(Window.partitionBy("session")), F.lit(0)))
    bounds = rows.agg(F.percentile_approx("written", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 1000)).first()[0] or []
    part = sum((F.when(F.col("written") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for k in range(parts):
        rows.filter(part == k).select("session", "number", "line", "written").repartition(2, "session").write.parquet(f"{root}/landing/part-{k:03d}")
    written = f"{root}/facts"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(written)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("session string, number long, line string, written long").option("maxFilesPerTrigger", 2).option("latestFirst", "false").parquet(f"{root}/landing/part-*")
        run = live_facts(actions(source, ("written",))).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    facts = spark.read.schema(f"{OUTPUT}, batch int").parquet(written)
    last = F.struct("batch", "ended")
    names = [f.split()[0] for f in OUTPUT.split(", ")]
    return facts.groupBy("session").agg(F.max_by(F.struct(*names[1:]), last).alias("f")).select("session", "f.*")
