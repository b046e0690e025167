"""Queries from session transcripts: files of JSON lines, scanned, parsed to records, blocks, calls and usage.

``conversations`` gives the transcripts: ``files_of`` writes each conversation as the text of one file, with
what real files have: streamed parts of one message, tool calls and results (some missing), repeated
records, titles, lines that are no JSON, blank lines, carriage returns and last lines cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core
from ..sources import transcripts as ts

KNOWN = ("user", "assistant", "system", "summary", "custom-title", "ai-title")
LINE_BYTES, FILE_BYTES, FILE_LINES = 8 << 20, 256 << 20, 100_000

# One SQL fragment per kind of line, in words that both engines know; {q} is the text as a JSON string.
_AT = "CASE WHEN conv_id % 2 = 0 THEN 1704067200 + conv_id * 3600 + turn * 60 ELSE (1704067200 + conv_id * 3600 + turn * 60) * 1000 END"
_HEAD = """'","sessionId":"s', conv_id, '","timestamp":', {at}, ',"cwd":"/home/u', conv_id % 3, '/p', conv_id % 5, '","message":{{'"""
_TOOL = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' WHEN 3 THEN 'mcp__db__query' ELSE 'Grep' END"
_INPUT = "CASE (conv_id + turn) % 5 WHEN 1 THEN concat('{\"command\":\"make p', turn, '\"}') WHEN 4 THEN concat('{\"pattern\":\"x', conv_id % 9, '\"}') ELSE concat('{\"file_path\":\"/home/u/src/f', conv_id % 7, '.py\"}') END"
_USAGE = "concat('\"usage\":{\"input_tokens\":', conv_id % 50, ',\"output_tokens\":', OUT, ',\"cache_read_input_tokens\":', turn * 100, ',\"cache_creation_input_tokens\":', conv_id % 30, CASE WHEN conv_id % 4 = 0 THEN concat(',\"cache_creation\":{\"ephemeral_5m_input_tokens\":', conv_id % 30, ',\"ephemeral_1h_input_tokens\":0}') ELSE '' END, '}')"


def line_expressions(q: str) -> list[tuple[str, str]]:
    """(condition, line) of each kind of line that a row may give, in order."""
    head = _HEAD.format(at=_AT)
    ask = f"CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN '\"<command-name>/review</command-name><command-args>all</command-args>\"' WHEN conv_id % 10 = 4 AND turn = 2 THEN '\"[Request interrupted by user]\"' ELSE {q} END"
    user = f"concat('{{\"type\":\"user\",\"uuid\":\"u', conv_id, '-', turn, {head}, '\"role\":\"user\",\"content\":', {ask}, '}}}}')"
    first = f"concat('{{\"type\":\"assistant\",\"uuid\":\"a', conv_id, '-', turn, {head}, '\"id\":\"m', conv_id, '-', turn, '\",\"role\":\"assistant\",\"model\":\"us.vendor.large-4-20250101-v1:0\",\"content\":[{{\"type\":\"text\",\"text\":', {q}, '}},{{\"type\":\"thinking\",\"thinking\":\"so\"}}],', {_USAGE.replace('OUT', '1')}, '}}}}')"
    call = f"concat('{{\"type\":\"assistant\",\"uuid\":\"b', conv_id, '-', turn, {head}, '\"id\":\"m', conv_id, '-', turn, '\",\"role\":\"assistant\",\"model\":\"us.vendor.large-4-20250101-v1:0\",\"stop_reason\":\"tool_use\",\"content\":[{{\"type\":\"tool_use\",\"id\":\"c', conv_id, '-', turn, '\",\"name\":\"', {_TOOL}, '\",\"input\":', {_INPUT}, '}}],', {_USAGE.replace('OUT', 'conv_id % 40 + 2')}, '}}}}')"
    done = f"concat('{{\"type\":\"user\",\"uuid\":\"r', conv_id, '-', turn, '\",\"sessionId\":\"s', conv_id, '\",\"timestamp\":', (1704067200 + conv_id * 3600 + turn * 60 + conv_id % 13 - 2) * 1000, ',\"message\":{{\"role\":\"user\",\"content\":[{{\"type\":\"tool_result\",\"tool_use_id\":\"c', conv_id, '-', turn, '\",\"is_error\":', CASE WHEN conv_id % 6 = 1 THEN 'true' ELSE 'false' END, ',\"content\":\"done ', turn, '\"}}]}}}}')"
    anon = f"concat('{{\"type\":\"assistant\",\"uuid\":\"d', conv_id, '-', turn, {head}, '\"role\":\"assistant\",\"model\":\"us.vendor.large-4-20250101-v1:0\",\"content\":[{{\"type\":\"text\",\"text\":\"no id\"}}],', {_USAGE.replace('OUT', '7')}, '}}}}')"
    made = f"concat('{{\"type\":\"assistant\",\"uuid\":\"y', conv_id, '-', turn, {head}, '\"id\":\"y', conv_id, '-', turn, '\",\"role\":\"assistant\",\"model\":\"<synthetic>\",\"content\":[{{\"type\":\"text\",\"text\":\"limit reached\"}}],', {_USAGE.replace('OUT', '5')}, '}}}}')"
    title = "concat('{\"type\":\"', CASE WHEN conv_id % 12 = 0 THEN 'custom-title' ELSE 'ai-title' END, '\",\"sessionId\":\"s', conv_id, '\",\"title\":\"Title ', conv_id, '\"}')"
    return [
        ("turn = 0 AND conv_id % 6 = 0", title), ("turn = 0 AND conv_id % 9 = 2", "concat('{\"type\":\"mystery\",\"uuid\":\"x', conv_id, '\"}')"), ("role = 'user'", user), ("turn = 1 AND conv_id % 7 = 0", "' {\"type\":\"user\"}'"), ("turn = 1 AND conv_id % 7 = 1", "'{\"type\":\"user\", broken'"),
        ("turn = 1 AND conv_id % 5 = 0", "''"), ("role = 'assistant'", first), ("role = 'assistant'", call), ("role = 'assistant' AND conv_id % 8 = 1", call), ("role = 'assistant' AND (conv_id + turn) % 7 <> 0", done),
        ("role = 'assistant' AND conv_id % 13 = 3", anon), ("role = 'assistant' AND conv_id % 17 = 5", made),
    ]


def files_of(conversations: DataFrame) -> DataFrame:
    """(session, slug, content): one file of JSON lines per conversation, whose turns are few."""
    q = "substr(to_json(named_struct('a', coalesce(text, ''))), 6, length(to_json(named_struct('a', coalesce(text, '')))) - 6)"
    lines = F.array(*[F.expr(f"CASE WHEN {cond} THEN {line} END") for cond, line in line_expressions(q)])
    rows = conversations.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode(lines).alias("n", "line")).filter("line is not null")
    every = F.array_sort(F.collect_list(F.struct("turn", "n", "line")))
    end = F.when(F.col("conv_id") % 4 == 1, "\r\n").otherwise("\n")
    text = F.array_join(F.transform(every, lambda x: x["line"]), "\n")
    files = rows.groupBy("conv_id").agg(text.alias("t"))
    text = F.when(F.col("conv_id") % 4 == 1, F.regexp_replace("t", "\n", "\r\n")).otherwise(F.col("t"))
    tail = F.when(F.col("conv_id") % 11 == 0, F.lit('\n{"type":"assistant","mess')).otherwise(end)
    return files.select(F.concat(F.lit("s"), "conv_id").alias("session"), F.concat(F.lit("-home-u-p"), F.col("conv_id") % 5).alias("slug"), F.concat(text, tail).alias("content"))


def _sql_files() -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN {line} END" for cond, line in line_expressions("to_json(coalesce(text, ''))"))
    return f"""
WITH k0 AS (SELECT conv_id, turn, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT conv_id, turn, [{parts}] AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
files AS (SELECT concat('s', conv_id) AS session, concat('-home-u-p', conv_id % 5) AS slug, conv_id, CASE WHEN conv_id % 4 = 1 THEN replace(string_agg(line, chr(10) ORDER BY turn, n), chr(10), chr(13) || chr(10)) ELSE string_agg(line, chr(10) ORDER BY turn, n) END
  || CASE WHEN conv_id % 11 = 0 THEN chr(10) || '{{"type":"assistant","mess' WHEN conv_id % 4 = 1 THEN chr(13) || chr(10) ELSE chr(10) END AS content FROM k0 WHERE line IS NOT NULL GROUP BY conv_id),
raw AS (SELECT session, slug, generate_subscripts(p, 1) AS number, len(p) AS pieces, regexp_replace(unnest(p), '\\r$', '') AS line FROM (SELECT session, slug, string_split(content, chr(10)) AS p FROM files)),
lines AS (SELECT *, starts_with(line, '{{') AND coalesce(json_valid(line), false) AS good FROM raw WHERE line <> ''),
rec AS (SELECT session, slug, number, line::JSON AS j, line::JSON->>'$.type' AS type FROM lines WHERE good),
msg AS (SELECT session, slug, number, type, j->>'$.uuid' AS uuid, j->>'$.message.id' AS mid, TRY_CAST(j->>'$.timestamp' AS DOUBLE) AS t, j->'$.message.content' AS c, j->>'$.message.stop_reason' AS stop, j->'$.message.usage' AS u, j->>'$.message.model' AS model, j->>'$.title' AS title, j->>'$.cwd' AS cwd FROM rec),
one AS (SELECT * EXCLUDE (q), CAST(CASE WHEN t <= 1e12 THEN t * 1000 ELSE t END AS BIGINT) AS ms FROM (SELECT *, CASE WHEN uuid IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY session, uuid ORDER BY number) END AS q FROM msg) WHERE q = 1),
blk AS (SELECT session, number, ms, mid, generate_subscripts(bs, 1) AS block, unnest(bs) AS b FROM (SELECT session, number, ms, mid, CASE WHEN json_type(c) = 'ARRAY' THEN c::JSON[] ELSE [json_object('type', 'text', 'text', c->>'$')] END AS bs FROM one WHERE c IS NOT NULL)),
bl AS (SELECT *, b->>'$.type' AS kind FROM blk)"""


def lines_of(files: DataFrame) -> DataFrame:
    """session, slug, number (from 1, blank lines count), last (no newline follows), line; blank lines are left out."""
    pieces = F.split("content", "\n")
    rows = files.select("session", "slug", F.size(pieces).alias("pieces"), F.posexplode(pieces).alias("at", "raw"))
    return rows.select("session", "slug", (F.col("at") + 1).cast("long").alias("number"), (F.col("at") == F.col("pieces") - 1).alias("last"), F.regexp_replace("raw", "\r$", "").alias("line")).filter("line <> ''")


def _good(line: Column) -> Column:
    """Whether a line is a JSON object: it must begin with the brace."""
    return line.startswith("{") & F.try_parse_json(line).isNotNull()


def scan_report(files: DataFrame) -> DataFrame:
    """Lines, records, bad lines and the first one, the longest line, a cut-off tail, and the size limit that a file breaks."""
    size = files.select("session", F.octet_length("content").cast("long").alias("bytes"))
    rows = lines_of(files).withColumn("good", _good(F.col("line")))
    out = rows.groupBy("session").agg(
        F.count("*").alias("lines"), F.count(F.when(F.col("good"), 1)).alias("records"), F.count(F.when(~F.col("good"), 1)).alias("bad"), F.min(F.when(~F.col("good"), F.col("number"))).alias("first_bad"),
        F.max(F.octet_length("line")).cast("long").alias("longest"), F.coalesce(F.bool_or(F.col("last") & ~F.col("good")), F.lit(False)).alias("possibly_live"),
    )
    reject = F.when(F.col("longest") > LINE_BYTES, "line").when(F.col("records") > FILE_LINES, "records").when(F.col("bytes") > FILE_BYTES, "file")
    return out.join(size, "session").withColumn("rejected", F.coalesce(reject, F.lit("no")))


def records_of(files: DataFrame) -> DataFrame:
    """Good lines parsed: session, ord, r (typed fields); see ``sources.transcripts``."""
    rows = lines_of(files).filter(_good(F.col("line")))
    return rows.select("session", "slug", F.col("number").alias("ord"), F.from_json("line", ts.SCHEMA).alias("r"), F.from_json("line", "title string").alias("extra"))


def record_census(files: DataFrame) -> DataFrame:
    """Records of each type, repeats among them, and whether the type is known."""
    r = records_of(files)
    first = ts.first_of_uuid(r)
    every = r.groupBy("session", F.col("r.type").alias("type")).agg(F.count("*").alias("n"))
    kept = first.groupBy("session", F.col("r.type").alias("type")).agg(F.count("*").alias("kept"), F.min(ts.time_ms(F.col("r.timestamp"))).alias("first_ms"), F.max(ts.time_ms(F.col("r.timestamp"))).alias("last_ms"))
    return every.join(kept, ["session", "type"]).select("session", "type", "n", (F.col("n") - F.col("kept")).alias("repeats"), F.col("type").isin(*KNOWN).alias("known"), "first_ms", "last_ms")


def _blocks(files: DataFrame) -> DataFrame:
    return ts.blocks(ts.first_of_uuid(records_of(files)))


def block_census(files: DataFrame) -> DataFrame:
    b = _blocks(files)
    return b.groupBy("session", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("b.text")), F.lit(0)).cast("long").alias("text_bytes"))


def calls(files: DataFrame) -> DataFrame:
    """Every tool call with its category, a one-line summary of its input, and its result if there is one."""
    c = ts.tool_calls(_blocks(files))
    field = lambda name: F.get_json_object("input", f"$.{name}")
    summary = F.when(F.col("tool") == "Bash", field("command")).when(F.col("tool") == "Grep", field("pattern")).otherwise(F.element_at(F.split(F.coalesce(field("file_path"), F.lit("")), "/"), -1))
    server = F.when(F.col("tool").startswith("mcp__"), F.split("tool", "__")[1])
    return c.select("session", "call", "tool", tx.tool_category(F.col("tool")).alias("category"), server.alias("server"), summary.alias("summary"), "duration_ms", "is_error", F.col("unresolved").alias("unresolved"))


def usage(files: DataFrame) -> DataFrame:
    """Tokens of each session and model, every provider message once; a cache write without a split is a long one."""
    rows = ts.usage_events(ts.first_of_uuid(records_of(files))).withColumn("model", tx.normalize_model(F.col("model")))
    unsplit = (F.col("cache_write") > 0) & (F.col("short") + F.col("long") == 0)
    rows = rows.withColumn("long", F.when(unsplit, F.col("cache_write")).otherwise(F.col("long")))
    return rows.groupBy("session", "model").agg(F.count("*").alias("messages"), *[F.sum(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "short", "long")])


def titles(files: DataFrame) -> DataFrame:
    """Title (custom, else made, else of the first prompt that starts a turn), folder, start, prompts by kind."""
    r = ts.first_of_uuid(records_of(files))
    content = F.col("r.message.content")
    prompt = r.filter((F.col("r.type") == "user") & ~content.startswith("[{")).select("session", "ord", content.alias("text"), tx.prompt_kind(content, F.col("r.isMeta")).alias("kind"))
    command = F.concat_ws(" ", F.regexp_extract("text", r"<command-name>([^<]*)</command-name>", 1), F.regexp_extract("text", r"<command-args>([^<]*)</command-args>", 1))
    shown = F.when(F.col("kind") == "command", command).otherwise(tx.preview(F.col("text"), 60))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_prompts")
    asked = prompt.groupBy("session").agg(F.min_by(shown, F.when(F.col("kind") == "human", F.col("ord"))).alias("human"), F.min_by(shown, F.when(F.col("kind").isin("human", "command", "peer", "scheduled"), F.col("ord"))).alias("first"), count("human"), count("command"), count("interrupt"))
    named = r.groupBy("session").agg(
        F.max_by("extra.title", F.when(F.col("r.type") == "custom-title", F.col("ord"))).alias("custom"), F.max_by("extra.title", F.when(F.col("r.type") == "ai-title", F.col("ord"))).alias("made"),
        F.min_by("r.cwd", F.when(F.col("r.cwd").isNotNull(), F.col("ord"))).alias("cwd"), F.min(ts.time_ms(F.col("r.timestamp"))).alias("start_ms"),
    )
    return named.join(asked, "session", "left").select("session", F.coalesce("custom", "made", "human", "first", F.lit("")).alias("title"), "cwd", "start_ms", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("human_prompts", "command_prompts", "interrupt_prompts")])


def inventory(files: DataFrame) -> DataFrame:
    """Files of each project, newest first, with the shortest prefix of two characters or more that selects one session alone."""
    r = records_of(files).groupBy("session", "slug").agg(F.max(ts.time_ms(F.col("r.timestamp"))).alias("last_ms"))
    size = files.select("session", F.octet_length("content").cast("long").alias("bytes"))
    each = r.join(size, "session")
    # A prefix selects one session if its neighbours in the order of names do not have it.
    ids = Window.partitionBy(F.substring("session", 1, 2)).orderBy("session")
    before, after = F.coalesce(F.lag("session").over(ids), F.lit("")), F.coalesce(F.lead("session").over(ids), F.lit(""))
    each = each.withColumn("b", before).withColumn("a", after)
    need = F.greatest(F.lit(1), *[_common(F.col("session"), F.col(o)) for o in ("a", "b")]) + 1
    newest = Window.partitionBy("slug").orderBy(F.col("last_ms").desc(), "session")
    out = each.withColumn("need", need)
    return out.select("session", "slug", "bytes", "last_ms", F.row_number().over(newest).alias("place"), F.when(F.col("need") <= F.length("session"), F.expr("substring(session, 1, need)")).alias("prefix"))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two names."""
    steps = F.sequence(F.lit(1), F.length(a))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(n))


def projects(files: DataFrame) -> DataFrame:
    r = records_of(files)
    return r.groupBy("slug").agg(F.count_distinct("session").alias("sessions"), F.max(ts.time_ms(F.col("r.timestamp"))).alias("last_ms"))


def crosswalk(declared: DataFrame, used: DataFrame, keys: list[str], cap: int = 50) -> DataFrame:
    """Declared against used names: status used, idle or undeclared, calls, sessions, tools; ranked by calls, then name, up to ``cap`` a project."""
    sums = used.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"), F.count_distinct("tool").alias("tools"))
    both = declared.select(*keys, F.lit(True).alias("declared")).distinct().join(sums, keys, "full_outer")
    status = F.when(F.col("calls").isNull(), "idle").when(F.col("declared"), "used").otherwise("undeclared")
    out = both.select(*keys, status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "sessions", "tools")])
    return core.top_k(out, [keys[0]], [F.col("calls").desc(), keys[1]], cap)


def server_crosswalk(files: DataFrame) -> DataFrame:
    """MCP servers: every project declares search, the even ones db, too."""
    project = F.col("slug").substr(10, 9).cast("int")
    declared = files.select("slug", F.explode(F.when(project % 2 == 0, F.array(F.lit("db"), F.lit("search"))).otherwise(F.array(F.lit("search")))).alias("server")).distinct()
    used = calls(files).filter("server is not null").join(files.select("session", "slug"), "session")
    return crosswalk(declared, used, ["slug", "server"])


def model_drift(files: DataFrame) -> DataFrame:
    """Models that a project's sessions used against the one configured for it, by whole segments of the name: a setting of a family fits its members."""
    project = F.col("slug").substr(10, 9).cast("int")
    configured = files.select("slug", F.when(project < 3, "large").otherwise("small-1").alias("configured")).distinct()
    seen = usage(files).join(files.select("session", "slug"), "session").groupBy("slug", "model").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"))
    same = (F.col("model") == F.col("configured")) | F.array_contains(F.split("model", "-"), F.col("configured"))
    return seen.join(configured, "slug").select("slug", "model", "configured", "sessions", "messages", (~same).alias("drift"))


def _of_files(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(files_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    "transcript_scan": _of_files(scan_report), "transcript_records": _of_files(record_census), "transcript_blocks": _of_files(block_census), "transcript_calls": _of_files(calls),
    "transcript_usage": _of_files(usage), "transcript_titles": _of_files(titles), "session_inventory": _of_files(inventory), "project_inventory": _of_files(projects),
    "server_crosswalk": _of_files(server_crosswalk), "model_drift": _of_files(model_drift),
}
_CALLS = """, use AS (SELECT session, number, ms, b->>'$.id' AS call, b->>'$.name' AS tool, b->'$.input' AS i FROM bl WHERE kind = 'tool_use'),
res AS (SELECT * FROM (SELECT session, ms, b->>'$.tool_use_id' AS call, (b->>'$.is_error') = 'true' AS e, row_number() OVER (PARTITION BY session, b->>'$.tool_use_id' ORDER BY number DESC, block DESC) AS q FROM bl WHERE kind = 'tool_result') WHERE q = 1)"""
ORACLE = {
    "transcript_scan": _sql_files() + """ SELECT session, count(*) AS lines, count(CASE WHEN good THEN 1 END) AS records, count(CASE WHEN NOT good THEN 1 END) AS bad, min(CASE WHEN NOT good THEN number END) AS first_bad, max(strlen(line)) AS longest,
 coalesce(bool_or(number = pieces AND NOT good), false) AS possibly_live, (SELECT strlen(content) FROM files f WHERE f.session = lines.session) AS bytes, 'no' AS rejected FROM lines GROUP BY session""",
    "transcript_records": _sql_files() + """, n AS (SELECT session, type, count(*) AS n FROM rec GROUP BY ALL), k AS (SELECT session, type, count(*) AS kept, min(ms) AS first_ms, max(ms) AS last_ms FROM one GROUP BY ALL)
SELECT session, type, n, n - kept AS repeats, type IN ('user', 'assistant', 'system', 'summary', 'custom-title', 'ai-title') AS known, first_ms, last_ms FROM n JOIN k USING (session, type)""",
    "transcript_blocks": _sql_files() + " SELECT session, kind, count(*) AS n, coalesce(sum(strlen(b->>'$.text')), 0)::BIGINT AS text_bytes FROM bl GROUP BY ALL",
    "transcript_calls": _sql_files() + _CALLS + """ SELECT use.session AS session, use.call AS call, tool, CASE tool WHEN 'Read' THEN 'read' WHEN 'Bash' THEN 'shell' WHEN 'Edit' THEN 'edit' WHEN 'Grep' THEN 'search' ELSE 'mcp' END AS category, CASE WHEN starts_with(tool, 'mcp__') THEN string_split(tool, '__')[2] END AS server,
 CASE tool WHEN 'Bash' THEN i->>'$.command' WHEN 'Grep' THEN i->>'$.pattern' ELSE string_split(coalesce(i->>'$.file_path', ''), '/')[-1] END AS summary, CASE WHEN res.ms >= use.ms THEN res.ms - use.ms END AS duration_ms, coalesce(e, false) AS is_error, res.call IS NULL AS unresolved
 FROM use LEFT JOIN res ON res.session = use.session AND res.call = use.call""",
    "transcript_usage": _sql_files() + """, v AS (SELECT *, row_number() OVER (PARTITION BY session, coalesce(mid, concat('#', number)) ORDER BY stop IS NOT NULL DESC, (u->>'$.output_tokens')::BIGINT DESC, number DESC) AS q FROM one WHERE u IS NOT NULL AND model <> '<synthetic>'),
w AS (SELECT session, 'large-4' AS model, (u->>'$.input_tokens')::BIGINT AS i, (u->>'$.output_tokens')::BIGINT AS o, (u->>'$.cache_read_input_tokens')::BIGINT AS r, (u->>'$.cache_creation_input_tokens')::BIGINT AS w, coalesce((u->>'$.cache_creation.ephemeral_5m_input_tokens')::BIGINT, 0) AS s, coalesce((u->>'$.cache_creation.ephemeral_1h_input_tokens')::BIGINT, 0) AS l FROM v WHERE q = 1)
SELECT session, model, count(*) AS messages, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(r)::BIGINT AS cache_read, sum(s)::BIGINT AS short, sum(CASE WHEN w > 0 AND s + l = 0 THEN w ELSE l END)::BIGINT AS long FROM w GROUP BY ALL""",
    "server_crosswalk": _sql_files() + """, d AS (SELECT DISTINCT slug, 'search' AS server FROM files UNION SELECT slug, 'db' FROM files WHERE right(slug, 1)::INT % 2 = 0),
u AS (SELECT f.slug AS slug, string_split(b->>'$.name', '__')[2] AS server, count(*) AS calls, count(DISTINCT f.session) AS sessions, count(DISTINCT b->>'$.name') AS tools FROM bl JOIN files f ON f.session = bl.session WHERE kind = 'tool_use' AND starts_with(b->>'$.name', 'mcp__') GROUP BY ALL),
x AS (SELECT coalesce(d.slug, u.slug) AS slug, coalesce(d.server, u.server) AS server, CASE WHEN calls IS NULL THEN 'idle' WHEN d.slug IS NULL THEN 'undeclared' ELSE 'used' END AS status, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions, coalesce(tools, 0) AS tools FROM d FULL JOIN u ON d.slug = u.slug AND d.server = u.server)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY calls DESC, server)::INT AS rank FROM x) WHERE rank <= 50""",
    "model_drift": _sql_files() + """, v AS (SELECT session, slug, count(DISTINCT coalesce(mid, concat('#', number))) AS n FROM one WHERE u IS NOT NULL AND model <> '<synthetic>' GROUP BY ALL)
SELECT slug, 'large-4' AS model, CASE WHEN right(slug, 1)::INT < 3 THEN 'large' ELSE 'small-1' END AS configured, count(*) AS sessions, sum(n)::BIGINT AS messages, right(slug, 1)::INT >= 3 AS drift FROM v GROUP BY slug""",
    "project_inventory": _sql_files() + " SELECT slug, count(DISTINCT session) AS sessions, max(ms) AS last_ms FROM one GROUP BY 1",
    "session_inventory": _sql_files() + """, e AS (SELECT session, slug, max(ms) AS last_ms FROM one GROUP BY ALL), x AS (SELECT s.session, p.n, (SELECT count(*) FROM e o WHERE starts_with(o.session, left(s.session, p.n::INT))) AS c FROM e s, (SELECT unnest(range(2, 12)) AS n) p WHERE p.n <= length(s.session)),
g AS (SELECT session, min(n) AS n FROM x WHERE c = 1 GROUP BY 1) SELECT e.session AS session, slug, (SELECT strlen(content) FROM files f WHERE f.session = e.session) AS bytes, last_ms, row_number() OVER (PARTITION BY slug ORDER BY last_ms DESC, e.session)::INT AS place, left(e.session, g.n::INT) AS prefix FROM e LEFT JOIN g USING (session)""",
}
