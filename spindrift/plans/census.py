"""Census of raw records: JSON paths, integrity, streamed parts; and size guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import core
from ..sources.records import records
from .session_queries import REC, flag


def json_kind(value: Column) -> Column:
    return (
        F.when(value.isNull(), "null").when(value.rlike(r"^-?[0-9]+$"), "integer").when(value.rlike(r"^-?[0-9]+\.[0-9eE+-]+$"), "number")
        .when(value.isin("true", "false"), "boolean").when(value.startswith("{"), "object").when(value.startswith("["), "array").otherwise("string")
    )


def schema_census(df: DataFrame, kind: Column, body: Column) -> DataFrame:
    """Of each kind of record and top-level key: how often, of what type, least and greatest number, longest text."""
    pairs = df.select(kind.alias("record"), F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))
    number = F.col("value").try_cast("long")
    return pairs.groupBy("record", "key", json_kind(F.col("value")).alias("type")).agg(F.count("*").alias("n"), F.min(number).alias("least"), F.max(number).alias("greatest"), F.max(F.length("value")).cast("long").alias("longest"))


def integrity(rec: DataFrame) -> DataFrame:
    """Per session: repeated message ids, times that go back, sessions that change their week."""
    w = Window.partitionBy("session_id").orderBy("ord")
    back = rec.withColumn("back", (F.col("start_ms") < F.lag("start_ms").over(w)).cast("int"))
    seen = rec.groupBy("session_id", "message_id").agg(F.count("*").alias("n")).groupBy("session_id").agg(flag(F.col("n") > 1).alias("repeated_ids"))
    return back.groupBy("session_id").agg(F.count("*").alias("records"), F.coalesce(F.sum("back"), F.lit(0)).alias("times_back")).join(seen, "session_id")


def streamed_parts(rec: DataFrame) -> DataFrame:
    """Messages by number of parts: identical or different usage, and where the fullest part stands."""
    m = rec.groupBy("session_id", "message_id").agg(F.count("*").alias("parts"), F.countDistinct("output_tokens", "input_tokens").alias("d"), F.max_by("ord", F.struct("output_tokens", "ord")).alias("best"), F.max("ord").alias("last"))
    return m.groupBy("parts", (F.col("d") == 1).alias("same_usage"), (F.col("best") == F.col("last")).alias("fullest_last")).agg(F.count("*").alias("messages"))


def context_drops(rec: DataFrame) -> DataFrame:
    """Requests whose context is less than half of the one before, which was large."""
    w = Window.partitionBy("session_id").orderBy("ord")
    c = rec.withColumn("now", F.col("cache_read") + F.col("input_tokens")).withColumn("before", F.lag("now").over(w))
    return c.filter("before > 8000 and now * 2 < before").select("session_id", "ord", "before", "now")


def tool_census(rec: DataFrame) -> DataFrame:
    return rec.groupBy("tool").agg(F.count("*").alias("uses"), flag(F.col("is_error")).alias("errors"), F.sum("result_bytes").alias("bytes"), core.nearest_rank("result_bytes", 0.5).alias("median_bytes"), F.countDistinct("path").alias("paths"))


def size_guards(docs: DataFrame, id_col: str, text_col: str, most_bytes: int) -> DataFrame:
    """Rows that a size limit rejects, with the reason; nothing is cut."""
    n = F.octet_length(text_col)
    return docs.select(F.col(id_col), n.cast("long").alias("bytes"), F.when(n > most_bytes, "too-long").when(n == 0, "empty").alias("reason")).filter("reason is not null")


def frozen_baseline(rec: DataFrame) -> DataFrame:
    """Audit of a baseline frozen at a cut: what had been written by then against what the times say now.

    The cut is a workspace's middle record; records of an earlier time that were written after it are what
    the frozen numbers lack. The first number that differs is named.
    """
    cut = rec.groupBy("workspace").agg(core.nearest_rank("ord", 0.5).alias("cut"))
    at = rec.join(cut, "workspace")
    when = at.groupBy("workspace").agg(F.max_by("start_ms", F.when(F.col("ord") == F.col("cut"), F.col("ord"))).alias("cut_ms"))
    both = at.join(when, "workspace")
    sums = lambda cond, name: (F.coalesce(F.sum(F.when(cond, F.col("input_tokens"))), F.lit(0)).alias(f"{name}_tokens"), F.count_distinct(F.when(cond, F.col("session_id"))).alias(f"{name}_sessions"))
    out = both.groupBy("workspace").agg(*sums(F.col("ord") <= F.col("cut"), "stored"), *sums(F.col("start_ms") <= F.col("cut_ms"), "derived"))
    violation = F.when(F.col("stored_sessions") != F.col("derived_sessions"), "sessions").when(F.col("stored_tokens") != F.col("derived_tokens"), "tokens")
    return out.withColumn("violation", violation)


def _rec(f):
    return lambda spark, sf_dir: f(records(spark, sf_dir))


QUERIES = {
    "schema_census": lambda spark, sf_dir: schema_census(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type"), F.col("props")),
    "integrity_census": _rec(integrity),
    "streamed_parts": _rec(streamed_parts),
    "context_drops": _rec(context_drops),
    "tool_census": _rec(tool_census),
    "size_guards": lambda spark, sf_dir: size_guards(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 20_000),
    "frozen_baseline": _rec(frozen_baseline),
}
ORACLE = {
    "schema_census": """SELECT event_type AS record, key, CASE WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'integer' ELSE 'string' END AS type, count(*) AS n, min(try_cast(v AS BIGINT)) AS least, max(try_cast(v AS BIGINT)) AS greatest, max(length(v)) AS longest
FROM (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS v) GROUP BY ALL""",
    "integrity_census": REC + """, b AS (SELECT session_id, CASE WHEN start_ms < lag(start_ms) OVER (PARTITION BY session_id ORDER BY ord) THEN 1 ELSE 0 END AS back FROM rec), m AS (SELECT session_id, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated_ids FROM (SELECT session_id, message_id, count(*) AS n FROM rec GROUP BY ALL) GROUP BY 1)
SELECT session_id, count(*) AS records, sum(back)::BIGINT AS times_back, any_value(repeated_ids) AS repeated_ids FROM b JOIN m USING (session_id) GROUP BY 1""",
    "streamed_parts": REC + """, m AS (SELECT session_id, message_id, count(*) AS parts, count(DISTINCT (output_tokens, input_tokens)) AS d, arg_max(ord, (output_tokens, ord)) AS best, max(ord) AS last FROM rec GROUP BY ALL)
SELECT parts, d = 1 AS same_usage, best = last AS fullest_last, count(*) AS messages FROM m GROUP BY ALL""",
    "context_drops": REC + """, c AS (SELECT session_id, ord, cache_read + input_tokens AS now, lag(cache_read + input_tokens) OVER (PARTITION BY session_id ORDER BY ord) AS before FROM rec) SELECT session_id, ord, before, now FROM c WHERE before > 8000 AND now * 2 < before""",
    "tool_census": REC + """SELECT tool, count(*) AS uses, sum(CASE WHEN is_error THEN 1 ELSE 0 END)::BIGINT AS errors, sum(result_bytes)::BIGINT AS bytes, quantile_disc(result_bytes, 0.5) AS median_bytes, count(DISTINCT path) AS paths FROM rec GROUP BY 1""",
    "size_guards": """SELECT doc_id, strlen(text) AS bytes, CASE WHEN strlen(text) > 20000 THEN 'too-long' ELSE 'empty' END AS reason FROM documents WHERE strlen(text) > 20000 OR strlen(text) = 0""",
    "frozen_baseline": REC + """, c AS (SELECT workspace, quantile_disc(ord, 0.5) AS cut FROM rec GROUP BY 1), t AS (SELECT c.workspace, cut, start_ms AS cut_ms FROM c JOIN rec ON rec.workspace = c.workspace AND rec.ord = c.cut),
 old AS (SELECT rec.workspace AS w, sum(input_tokens)::BIGINT AS n, count(DISTINCT session_id) AS s FROM rec JOIN t ON t.workspace = rec.workspace AND rec.ord <= t.cut GROUP BY 1),
 new AS (SELECT rec.workspace AS w, sum(input_tokens)::BIGINT AS n, count(DISTINCT session_id) AS s FROM rec JOIN t ON t.workspace = rec.workspace AND rec.start_ms <= t.cut_ms GROUP BY 1)
 SELECT old.w AS workspace, old.n AS stored_tokens, old.s AS stored_sessions, new.n AS derived_tokens, new.s AS derived_sessions, CASE WHEN old.s <> new.s THEN 'sessions' WHEN old.n <> new.n THEN 'tokens' END AS violation FROM old JOIN new ON new.w = old.w""",
}
