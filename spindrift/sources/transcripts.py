"""Scan of session transcripts in JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the part of a record that the scan reads.
SCHEMA = (
    "type string, uuid string, sessionId string, timestamp string, isMeta boolean, isSidechain boolean, agentId string, cwd string, gitBranch string,"
    " message struct<id: string, role: string, model: string, stop_reason: string, content: string,"
    " usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long, cache_creation: struct<ephemeral_5m_input_tokens: long, ephemeral_1h_input_tokens: long>>>"
)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder as records; see ``parse_lines``."""
    return parse_lines(spark.read.text(path).select("value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """kind, session_id, uuid, role, text, time_ms, agent_id, usage of each line that holds a JSON object.

    Empty lines are skipped; a line that is no JSON object has kind ``bad-line``. Content that is a
    list gives the text of its text blocks, joined by newlines.
    """
    line = F.regexp_replace("value", r"\r$", "")
    rows = lines.select(line.alias("line")).filter("line <> ''").withColumn("r", F.from_json("line", SCHEMA))
    blocks = F.from_json("r.message.content", "array<struct<type: string, text: string>>")
    listed = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(F.col("r.message.content").startswith("[{") & blocks.isNotNull(), listed).otherwise(F.col("r.message.content"))
    good = F.col("line").startswith("{") & F.col("r.type").isNotNull()
    return rows.select(
        F.when(good, F.col("r.type")).otherwise("bad-line").alias("kind"), F.col("r.sessionId").alias("session_id"), F.col("r.uuid").alias("uuid"), F.col("r.message.role").alias("role"), text.alias("text"),
        time_ms(F.col("r.timestamp")).alias("time_ms"), F.col("r.agentId").alias("agent_id"), F.col("r.message.id").alias("message_id"), F.col("r.message.model").alias("model"), "r.message.usage",
    )


def time_ms(value: Column) -> Column:
    """Milliseconds: a number up to 1e12 is seconds, a larger one milliseconds, a text a time of day; else null."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.when(number <= 1e12, number * 1000).otherwise(number).cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(value)))


#: Fixed value: the fields of content blocks that the scan reads.
BLOCK = "type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string, is_error boolean"
KINDS = ("text", "thinking", "redacted_thinking", "tool_use", "tool_result", "image", "document", "fallback")


def numbered(lines: DataFrame, session: str, order: str) -> DataFrame:
    """Parsed lines with ``ord`` (the line's place) and the session of the file they come from."""
    return parse_lines_with(lines, [F.col(session).alias("session"), F.col(order).cast("long").alias("ord")])


def parse_lines_with(lines: DataFrame, keep: list[Column]) -> DataFrame:
    line = F.regexp_replace("value", r"\r$", "")
    rows = lines.select(*keep, line.alias("line")).filter("line <> ''").withColumn("r", F.from_json("line", SCHEMA))
    names = [c for c in rows.columns if c not in ("line", "r")]
    good = F.col("line").startswith("{") & F.col("r.type").isNotNull()
    return rows.select(*names, F.when(good, F.col("r.type")).otherwise("bad-line").alias("kind"), "r", "line")


def blocks(records: DataFrame) -> DataFrame:
    """One row per content block of each message: session, ord, block, kind, fields, bytes. Text content is one text block."""
    content = F.col("r.message.content")
    listed = F.from_json(content, f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in BLOCK.split(', '))}>>")
    single = F.array(F.struct(*[F.lit("text").alias("type") if f.startswith("type ") else content.alias("text") if f.startswith("text ") else F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in BLOCK.split(", ")]))
    rows = records.filter(content.isNotNull()).select("session", "ord", F.col("r.message.id").alias("message_id"), F.col("r.agentId").alias("agent_id"), time_ms(F.col("r.timestamp")).alias("ms"), F.posexplode(F.when(content.startswith("[{"), listed).otherwise(single)).alias("block", "b"))
    return rows.select("session", "ord", "message_id", "agent_id", "ms", "block", F.when(F.col("b.type").isin(*KINDS), F.col("b.type")).otherwise("unknown").alias("kind"), "b", F.octet_length(F.coalesce("b.text", "b.input", "b.content", F.lit(""))).alias("bytes"))


def tool_calls(content: DataFrame) -> DataFrame:
    """Tool uses with their results: the last result of an id wins; a use without one is unresolved.

    Duration only where the end is not before the start. Results without a use are not here; see ``orphans``.
    """
    uses = content.filter("kind = 'tool_use'").select("session", "ord", "block", "message_id", "agent_id", F.col("b.id").alias("call"), F.col("b.name").alias("tool"), F.col("b.input").alias("input"), F.col("ms").alias("start_ms"))
    results = content.filter("kind = 'tool_result'").groupBy("session", F.col("b.tool_use_id").alias("call")).agg(F.max_by(F.struct("ms", F.col("b.is_error").alias("is_error"), "bytes"), F.struct("ord", "block")).alias("x"))
    joined = uses.join(results, ["session", "call"], "left")
    end = F.col("x.ms")
    return joined.select("session", "ord", "block", "message_id", "agent_id", "call", "tool", "input", "start_ms", F.when(end >= F.col("start_ms"), end - F.col("start_ms")).alias("duration_ms"), F.coalesce("x.is_error", F.lit(False)).alias("is_error"), F.col("x").isNull().alias("unresolved"), F.col("x.bytes").alias("result_bytes"))


def orphans(content: DataFrame) -> DataFrame:
    """Results whose use is not there."""
    uses = content.filter("kind = 'tool_use'").select("session", F.col("b.id").alias("call"))
    return content.filter("kind = 'tool_result'").select("session", "ord", F.col("b.tool_use_id").alias("call")).join(uses, ["session", "call"], "left_anti")


def usage_events(records: DataFrame) -> DataFrame:
    """Usage of each provider message once: the part with a stop reason, then most output, then the last. A record without a message id is one of its own; made-up ones do not count."""
    from ..operators.core import first_by

    u = F.col("r.message.usage")
    rows = records.filter(u.isNotNull()).select(
        "session", "ord", F.coalesce(F.col("r.message.id"), F.concat(F.lit("#"), F.col("ord"))).alias("message_id"), F.col("r.message.model").alias("model"), F.col("r.message.stop_reason").alias("stop"),
        *[F.coalesce(u[f], F.lit(0)).alias(n) for f, n in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_input_tokens", "cache_read"), ("cache_creation_input_tokens", "cache_write"))],
        F.coalesce(u["cache_creation"]["ephemeral_5m_input_tokens"], F.lit(0)).alias("short"), F.coalesce(u["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0)).alias("long"),
    ).filter("model is null or model <> '<synthetic>'")
    return first_by(rows, ["session", "message_id"], [F.col("stop").isNotNull().desc(), F.col("output_tokens").desc(), F.col("ord").desc()])


def first_of_uuid(records: DataFrame) -> DataFrame:
    """Records whose uuid came before are dropped; those without one stay."""
    from ..operators.core import first_by

    return first_by(records.filter("r.uuid is not null").withColumn("uuid", F.col("r.uuid")), ["session", "uuid"], ["ord"]).drop("uuid").unionByName(records.filter("r.uuid is null"))
