"""Alerts from a stream of records: a session's move into a level that asks for someone, debounced.

State per session is its last level and the time of its last alert; records of a session are taken in
the order of their number within a batch, batches in the order in which they land.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .sessions import SCHEMA, shared_folder

LEVELS = {"error": "stuck", "purchase": "your-turn"}
OUTPUT, STATE = "user_id long, event_id long, level string", "level string, alerted long"


def decide(level: str | None, alerted: int | None, moves: list[tuple[int, int, str]], quiet_ms: int) -> tuple[str | None, int | None, list[tuple[int, str]]]:
    """New level and last alert time after ``moves`` (number, ms, type), and the alerts. The first record gives no alert."""
    out = []
    for number, ms, kind in moves:
        now = LEVELS.get(kind, "working")
        if level is not None and now != level and now != "working" and (alerted is None or ms - alerted >= quiet_ms):
            alerted = ms
            out.append((number, now))
        level = now
    return level, alerted, out


def alerts(stream: DataFrame, quiet_ms: int = 300_000) -> DataFrame:
    """user_id, event_id and level of each alert."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, alerted = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("event_id")
        level, alerted, out = decide(level, None if alerted is None or alerted < 0 else int(alerted), list(zip(rows.event_id, rows.ms, rows.event_type)), quiet_ms)
        state.update((level, -1 if alerted is None else int(alerted)))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": [n for n, _ in out], "level": [x for _, x in out]})

    rows = stream.select("user_id", "event_id", F.unix_millis("ts").alias("ms"), "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def alerts_of_landed(events: DataFrame, files: int = 4) -> DataFrame:
    """Land ``events`` in the order of their numbers as files of ranges, stream them, return all alerts."""
    spark = events.sparkSession
    root = shared_folder(spark)
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    bounds = rows.agg(F.percentile("event_id", F.array(*[F.lit(k / files) for k in range(1, files)]))).first()[0] or []
    part = sum((F.when(F.col("event_id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for k in range(files):
        rows.filter(part == k).write.parquet(f"{root}/landing/part-{k:03d}")
    written = f"{root}/alerts"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(written)

    run = alerts(spark.readStream.schema(SCHEMA).option("latestFirst", "false").parquet(f"{root}/landing/part-*")).writeStream.outputMode("append")
    run = run.option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(written)
