"""Queries of the generic operators and of the text jobs on the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None):
    """Register a function of (table, ...) that gets a reader of tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("line_price_percentiles", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.5) AS p50, count(*) AS n FROM lineitem GROUP BY ALL")
def line_price_percentiles(read) -> DataFrame:
    return core.nearest_ranks(read("lineitem"), ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "p50": 0.5})


@query("last_ship_before_order", """WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders), r AS (SELECT o_custkey AS c, l_shipdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, o_orderkey, (SELECT max(d) FROM r WHERE c = o_custkey AND d <= o_orderdate) AS shipped FROM x""")
def last_ship_before_order(read) -> DataFrame:
    """As-of join: the last shipment to a customer on or before each of its orders."""
    orders = read("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ships = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_shipdate").alias("at"), F.col("l_shipdate").alias("shipped"))
    return core.asof_join(orders, ships, ["o_custkey"], "o_orderdate", "at", ["shipped"]).select("o_custkey", "o_orderkey", "shipped")


@query("next_ship_after_order", """WITH r AS (SELECT o_custkey AS c, l_shipdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, o_orderkey, (SELECT min(d) FROM r WHERE c = o_custkey AND d >= o_orderdate) AS shipped FROM orders""")
def next_ship_after_order(read) -> DataFrame:
    orders = read("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ships = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_shipdate").alias("at"), F.col("l_shipdate").alias("shipped"))
    return core.asof_join(orders, ships, ["o_custkey"], "o_orderdate", "at", ["shipped"], "forward").select("o_custkey", "o_orderkey", "shipped")


@query("bounded_claims", """WITH p AS (SELECT o_orderpriority AS rule, o_custkey AS session, sum(o_orderkey % 97)::BIGINT AS c FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY session) AS q FROM p), f AS (SELECT rule, string_agg(session::VARCHAR, ',' ORDER BY session) AS first_sessions, arg_max(session, (c, -q)) AS example FROM r WHERE q <= 5 GROUP BY 1)
SELECT rule, count(*) AS sessions, sum(c)::BIGINT AS claimed, floor(least(sum(c)::DOUBLE, median(c) * count(*)) + 0.5)::BIGINT AS bounded, any_value(first_sessions) AS first_sessions, any_value(example) AS example FROM p JOIN f USING (rule) GROUP BY rule""")
def bounded_claims(read) -> DataFrame:
    """Roll-up of findings by rule; the claim of all is bounded by median times sessions."""
    findings = read("orders").select(F.col("o_orderpriority").alias("rule"), F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 97).cast("long").alias("claim"))
    return core.bounded_rollup(findings, "rule", "session", "claim")


@query("declared_vs_used_parts", """WITH d AS (SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey % 3 <> 0), u AS (SELECT l_partkey AS key, count(*) AS uses FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT coalesce(d.key, u.key) AS key, CASE WHEN d.key IS NULL THEN 'undeclared' WHEN u.key IS NULL THEN 'idle' ELSE 'used' END AS status, coalesce(uses, 0) AS uses FROM d FULL JOIN u ON d.key = u.key""")
def declared_vs_used_parts(read) -> DataFrame:
    declared = read("part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"))
    return core.declared_vs_used(declared, read("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("key")), "key")


@query("status_counts", """WITH d AS (SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey % 3 <> 0), u AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 45)
SELECT CASE WHEN d.key IS NULL THEN 'undeclared' WHEN u.key IS NULL THEN 'idle' ELSE 'used' END AS status, count(*) AS n FROM d FULL JOIN u ON d.key = u.key GROUP BY 1""")
def status_counts(read) -> DataFrame:
    return declared_vs_used_parts(read).groupBy("status").agg(F.count("*").alias("n"))


#: Scopes from strongest to weakest.
SCOPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("settings_precedence", """SELECT o_custkey AS home, arg_min(o_orderkey, (o_orderpriority, -o_orderkey)) AS setting, min(o_orderpriority) AS scope FROM orders GROUP BY 1""")
def settings_precedence(read) -> DataFrame:
    """The value of the strongest scope, the latest within it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("o_orderpriority"))
    return read("orders").groupBy(F.col("o_custkey").alias("home")).agg(F.min_by("o_orderkey", F.struct(rank.alias("r"), (-F.col("o_orderkey")).alias("k"))).alias("setting"), F.min("o_orderpriority").alias("scope"))


@query("interval_overlaps", """WITH s AS (SELECT o_custkey AS c, o_orderkey AS k, epoch(o_orderdate)::BIGINT AS a, epoch(o_orderdate)::BIGINT + 86400 * 30 AS b FROM orders)
SELECT x.c AS customer, x.k AS first_order, y.k AS other_order FROM s x JOIN s y ON x.c = y.c AND x.k < y.k AND x.a <= y.b AND y.a <= x.b""")
def interval_overlaps(read) -> DataFrame:
    """Orders of one customer whose 30-day spans overlap."""
    s = read("orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("first_order"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 86400 * 30)
    y = s.select("customer", F.col("first_order").alias("other_order"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return core.interval_overlap_join(s, y, ["customer"], ("a", "b"), ("a2", "b2"), 86400 * 30).filter("first_order < other_order").select("customer", "first_order", "other_order")


@query("conversation_turns", """SELECT conv_id, count(*) AS messages, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS prompts, sum(strlen(text))::BIGINT AS bytes, max(length(text)) AS longest FROM conversations GROUP BY ALL""")
def conversation_turns(read) -> DataFrame:
    """Messages parsed back from JSON lines, as a transcript scan reads them."""
    from ..sources.transcripts import parse_lines

    lines = read("conversations").select(F.to_json(F.struct(F.lit("message").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message"))).alias("value"))
    m = parse_lines(lines).filter("kind = 'message'")
    return m.groupBy(F.col("session_id").cast("long").alias("conv_id")).agg(F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("prompts"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.max(F.length("text")).cast("long").alias("longest"))


@query("corrections", """SELECT conv_id, turn, regexp_matches(text, '(?i)^\\s*(no|nope|wrong|stop|undo|revert)\\b') OR regexp_matches(text, '(?i)\\b(that is wrong|not what i|you forgot|still (fails|broken|wrong)|try again)\\b') AS correction FROM conversations WHERE role = 'user'""")
def corrections(read) -> DataFrame:
    return read("conversations").filter("role = 'user'").select("conv_id", "turn", tx.is_correction(F.col("text")).alias("correction"))


@query("previews", """WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, t[1:79] AS h, regexp_extract(t[1:79], '^(.*) [^ ]*$', 1) AS c FROM f)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE (CASE WHEN c = '' THEN h ELSE c END) || '…' END AS preview FROM h""")
def previews(read) -> DataFrame:
    return read("documents").select("doc_id", tx.preview(F.col("text"), 80).alias("preview"))


def _word_filter() -> str:
    return "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


WORDS = "list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '\\S*/\\S*', ' ', 'g'), '[a-z]{4,}'))"


@query("content_words", f"""SELECT conv_id, turn, len(list_filter({WORDS}, lambda w: NOT list_contains({_word_filter()}, w))) AS words FROM conversations""")
def content_words(read) -> DataFrame:
    return read("conversations").select("conv_id", "turn", F.size(tx.content_words(F.col("text"), 1 << 20)).cast("long").alias("words"))


@query("recurring_words", f"""WITH w AS (SELECT DISTINCT conv_id, unnest(list_filter({WORDS}, lambda w: NOT list_contains({_word_filter()}, w))) AS word FROM conversations WHERE role = 'user')
SELECT word, count(*) AS conversations FROM w GROUP BY 1 HAVING count(*) >= 2""")
def recurring_words(read) -> DataFrame:
    """Themes: content words of prompts in two conversations or more."""
    w = read("conversations").filter("role = 'user'").select("conv_id", F.explode(tx.content_words(F.col("text"), 1 << 20)).alias("word")).distinct()
    return w.groupBy("word").agg(F.count("*").alias("conversations")).filter("conversations >= 2")


@query("rare_shared_words", f"""WITH w AS (SELECT DISTINCT conv_id, unnest(list_filter({WORDS}, lambda w: NOT list_contains({_word_filter()}, w))) AS word FROM conversations WHERE role = 'user'),
n AS (SELECT count(DISTINCT conv_id) AS n FROM w), f AS (SELECT word, count(*) AS df FROM w GROUP BY 1) SELECT conv_id, count(*) AS rare_words FROM w JOIN f USING (word), n WHERE df >= 2 AND df <= greatest(3, ceil(0.05 * n)) GROUP BY 1""")
def rare_shared_words(read) -> DataFrame:
    """Words of a conversation that some, but at most max(3, 5 %) of all conversations share."""
    w = read("conversations").filter("role = 'user'").select("conv_id", F.explode(tx.content_words(F.col("text"), 1 << 20)).alias("word")).distinct()
    n = F.broadcast(w.agg(F.countDistinct("conv_id").alias("n")))  # one row
    df = w.groupBy("word").agg(F.count("*").alias("df")).join(n, F.lit(True)).filter((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(3), F.ceil(F.lit(0.05) * F.col("n")))))
    return w.join(df, "word").groupBy("conv_id").agg(F.count("*").alias("rare_words"))


@query("redaction_report", None)
def redaction_report(read) -> DataFrame:
    """Masked parts by kind, and documents with any."""
    counts = tx.redacted(read("documents").select("text"), "text", "_out", counts=True)
    kinds = [k for k, _ in tx.REDACTIONS]
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k in kinds])).alias("x")).select("x.kind", "x.n")
    return long.groupBy("kind").agg(F.sum("n").cast("long").alias("masked"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("documents"))


def _redact_sql(column: str) -> str:
    out = column
    for _, pattern, mark, _ in tx.STEPS:
        mark = mark.replace("$1", chr(92) + "1")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mark}', 'g')"
    return out


@query("redacted_documents", f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted_md5 FROM documents")
def redacted_documents(read) -> DataFrame:
    return tx.redacted(read("documents").select("doc_id", "text"), "text", "out").select("doc_id", F.md5("out").alias("redacted_md5"))


@query("text_lint", """WITH f AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '[.!?]+(?:\\s+|$)'), lambda s: s <> '') AS s, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, len(s) AS sentences, len(list_filter(s, lambda x: len(string_split(x, ' ')) > 25)) AS long_sentences, len(regexp_extract_all(t, ';')) AS semicolons, len(regexp_extract_all(t, '—')) AS dashes FROM f)
SELECT doc_id, sentences, long_sentences, semicolons, dashes, CASE WHEN sentences = 0 THEN 100 ELSE floor(100.0 * (sentences - long_sentences) / sentences + 0.5)::BIGINT END AS score FROM c""")
def text_lint(read) -> DataFrame:
    """Sentences, too long ones (over 25 words), marks, and the share of clean sentences as a score."""
    t = F.coalesce(F.col("text"), F.lit(""))
    s = read("documents").select("doc_id", t.alias("t"), tx.sentences(F.col("text")).alias("s"))
    c = s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size(F.filter("s", lambda x: F.size(F.split(x, " ")) > 25)).cast("long").alias("long_sentences"), F.regexp_count("t", F.lit(";")).cast("long").alias("semicolons"), F.regexp_count("t", F.lit("—")).cast("long").alias("dashes"))
    return c.withColumn("score", F.when(F.col("sentences") == 0, 100).otherwise(F.floor(100.0 * (F.col("sentences") - F.col("long_sentences")) / F.col("sentences") + 0.5)).cast("long"))


@query("command_templates", """WITH t AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '[A-Za-z0-9_.~-]*(?:/[A-Za-z0-9_.-]+)+', '«path»', 'g'), '\\b[0-9a-f]{7,40}\\b', '«hash»', 'g'), '[0-9]+', '«n»', 'g') AS template FROM pages) SELECT template, count(*) AS n FROM t GROUP BY 1""")
def command_templates(read) -> DataFrame:
    return read("pages").groupBy(tx.bash_template(F.col("url")).alias("template")).agg(F.count("*").alias("n"))


@query("streamed_sessions", """SELECT user_id, count(*) AS records, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, max(epoch_us(ts)) // 1000 AS last_ms FROM events GROUP BY 1""")
def streamed_sessions(read) -> DataFrame:
    """Running totals per session from a stream of landed files, all that has landed."""
    from ..streaming.sessions import totals_of_landed

    return totals_of_landed(read("events"))


@query("streamed_alerts", None)
def streamed_alerts(read) -> DataFrame:
    """Debounced alerts from a stream of landed files, with a state per user."""
    from ..streaming.alerts import alerts_of_landed

    return alerts_of_landed(read("events"))
