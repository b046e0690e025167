"""Session records from a table of events: one row per prompt or tool call, in session order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import dealt, running_index


def records_from_events(events: DataFrame, deal: bool = False) -> DataFrame:
    """Bind (event_id, ts, user_id, event_type, value, props) to session records.

    A ``signup`` is a prompt that starts a turn, the other types are tool calls; a session is a user's
    week. Rows before the first prompt have turn -1. ``deal``: sessions are dealt out at so many rows a task, for plans with many windows over them.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumn("k", k).select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")).alias("session_id"),
        F.col("event_id").alias("ord"), F.col("user_id").alias("workspace"), "event_type", "ts",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), "k",
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("a"), F.col("k") % 3)).alias("agent_id"),
        F.when(F.col("event_type") == "view", "Read").when(F.col("event_type").isin("click", "error"), "Bash").when(F.col("event_type") == "purchase", "Edit").alias("tool"),
        (F.col("event_type") == "error").alias("is_error"), F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("duration_ms"),
        (F.col("k") * 1000).cast("long").alias("result_bytes"), F.concat(F.lit("f"), F.col("k") % 7).alias("path"),
        F.concat(F.lit("m"), F.floor(F.col("event_id") / 2).cast("long")).alias("message_id"),
        F.col("k").cast("long").alias("input_tokens"), (F.col("k") * 100).cast("long").alias("cache_read"),
        (F.col("k") * 10).cast("long").alias("cache_write"), (F.col("k") % 13).cast("long").alias("output_tokens"),
    )
    if deal:
        e = dealt(e, ["session_id"], events.count())
    return running_index(e, ["session_id"], ["ord"], F.col("event_type") == "signup", "turn_index")


def records(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    return records_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), deal)
