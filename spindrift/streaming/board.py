"""A board of the sessions that run: the eight most recent, each with its last five calls, given out only when it says something new.

State per session is small, one row: counts, the last time, a ring of calls and the running agents. After each batch the sessions' newest rows are brought
together with those of the batches before, quiet ones leave, and the first eight make the board. The board is written only if
it differs from the last one in anything but times; the row hashes that decide are kept with it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import core
from ..sources.live import actions, live_lines
from .sessions import shared_folder

#: Places of the board, calls that a session shows, and the time after which a session is no longer on it.
PLACES, RING, QUIET_MS = 8, 5, 12 * 3_600_000
SESSION = "session string, turns long, calls long, running_agents long, recent string, last_at long"
BOARD = f"batch long, place int, {SESSION}"


class Recent(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        # One state of one row: each call of the state store is a round trip, and there are as many as sessions in a batch.
        self.state = handle.getValueState("session", "turns long, calls long, last_at long, ring string, agents string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        turns, calls, last, ring, agents = self.state.get() or (0, 0, None, "[]", "[]")
        ring, agents = json.loads(ring), dict.fromkeys(json.loads(agents))
        for a in sorted(rows, key=lambda r: r.ord):
            last = a.at if last is None else last if a.at is None else max(last, a.at)
            if a.kind == "prompt":
                turns += 1
                agents.clear()
            elif a.kind == "call":
                calls += 1
                ring = [*ring, a.tool][-RING:]
                if a.status == "subagent":
                    agents[a.id] = None
            elif a.kind == "result":
                agents.pop(a.id, None)
        self.state.update((turns, calls, last, json.dumps(ring), json.dumps(list(agents))))
        yield Row(session=key[0], turns=turns, calls=calls, running_agents=len(agents), recent=",".join(ring), last_at=last)

    def close(self) -> None:
        pass


def recent_sessions(stream: DataFrame) -> DataFrame:
    """A row (``SESSION``) per session that a batch of actions changes."""
    return stream.groupBy("session").transformWithState(Recent(), SESSION, "Update", "None")


def board_of(sessions: DataFrame, now_ms: int) -> DataFrame:
    """place and the rows of the most recent sessions that are not quiet."""
    live = sessions.filter(F.lit(now_ms) - F.col("last_at") < QUIET_MS)
    first = live.orderBy(F.col("last_at").desc(), "session").limit(PLACES)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.col("last_at").desc(), "session")))  # eight rows


def lasting(board: DataFrame) -> list[tuple]:
    """What of a board time alone does not move, as one hash a row."""
    return sorted(map(tuple, board.select("place", F.xxhash64("place", *[c for c in board.columns if c not in ("last_at", "batch", "place")])).collect()))


class Boards:
    """Takes batches of session rows; keeps the live sessions' newest rows and writes each new board below ``root``."""

    def __init__(self, root: str):
        self.root, self.latest, self.last, self.now = root, None, None, 0

    def take(self, batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number).cast("long")).persist()
        try:
            top = batch.agg(F.max("last_at")).first()[0]
            self.now = max(self.now, top or 0)
            every = batch if self.latest is None else self.latest.unionByName(batch)
            newest = core.first_by(every, ["session"], [F.col("batch").desc()]).filter(F.lit(self.now) - F.col("last_at") < QUIET_MS)
            path = f"{self.root}/live/batch-{number:06d}"
            newest.write.mode("overwrite").parquet(path)
            self.latest = batch.sparkSession.read.schema(newest.schema).parquet(path)
        finally:
            batch.unpersist()
        board = board_of(self.latest.drop("batch"), self.now)
        said = lasting(board)
        if said != self.last:
            self.last = said
            board.select(F.lit(number).cast("long").alias("batch"), "place", *[f.split()[0] for f in SESSION.split(", ")]).write.mode("append").parquet(f"{self.root}/boards")


def land(rows: DataFrame, root: str, parts: int, rows_per_file: int) -> tuple[DataFrame, int]:
    """Write each ``part`` of the lines in turn, all as the same number of files; the lines (session, number, line), and that number.

    The lines are made once. A part is one batch of a stream that takes so many files at a time.
    """
    spark = rows.sparkSession
    rows.write.partitionBy("part").parquet(f"{root}/lines")
    lines = spark.read.schema(rows.schema).parquet(f"{root}/lines")
    most = lines.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    files = max(1, math.ceil(most / rows_per_file))
    for k in range(parts):
        path, one = f"{root}/landing/part-{k:03d}", lines.filter(F.col("part") == k).drop("part")
        (one.coalesce(1) if files == 1 else one.repartition(files, "session", "number")).write.parquet(path)
        for _ in range(files - len(spark.read.schema(one.schema).parquet(path).inputFiles())):  # a task without rows writes none
            one.limit(0).coalesce(1).write.mode("append").parquet(path)
    return lines.drop("part"), files


def boards_of_landed(conversations: DataFrame, parts: int = 6, rows_per_file: int = 250_000) -> DataFrame:
    """Land transcript lines in ``parts`` parts, one a batch, and one line that only moves a time; return every board that was given out.

    Sessions land in the order of their numbers, their later turns a part after the rest.
    """
    spark = conversations.sparkSession
    root = shared_folder(spark)
    rows = live_lines(conversations).withColumn("conv", F.expr("cast(substring(session, 2, 18) as bigint)"))
    lo, hi = conversations.filter("turn is not null").agg(F.min("conv_id"), F.max("conv_id")).first()
    part = F.expr(f"cast(least({parts - 1}, ((conv - {lo or 0}) * {parts}) div {(hi or 0) - (lo or 0) + 1} + if(number >= 300, 1, 0)) as int)")
    lines, files = land(rows.select("session", "number", "line", part.alias("part")), root, parts, rows_per_file)
    newest = actions(lines).agg(F.max_by(F.struct("session", "at"), F.struct("at", F.expr("-cast(substring(session, 2, 18) as bigint)"))).alias("x"))
    idle = newest.select("x.session", F.lit(10**9).cast("long").alias("number"), F.concat(F.lit('{"type":"assistant","timestamp":'), F.col("x.at") + 1, F.lit(',"message":{"role":"assistant","model":"m","content":""}}')).alias("line"))
    idle.coalesce(1).write.parquet(f"{root}/landing/part-{parts:03d}")
    boards = Boards(root)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("session string, number long, line string").option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(f"{root}/landing/part-*")
        run = recent_sessions(actions(source)).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(boards.take).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(BOARD).parquet(f"{root}/boards")
