"""Links that fall back: models by name, alias, prefix or family; agents by id, by name and team, by name; agents to turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core
from .work_patterns import CALLS, bound_calls

# ---- models


def dash_prefixes(name: Column) -> Column:
    """a, a-b, a-b-c of a-b-c."""
    parts = F.split(name, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))


def model_tags(raw: Column) -> Column:
    """context:… and speed:fast, as the raw name says."""
    m = F.lower(F.trim(raw))
    context = F.regexp_extract(m, r"\[([0-9]+[km])\]$", 1)
    fast = F.regexp_replace(m, r"\[[^\]]*\]$", "").endswith("-fast")
    return F.concat_ws(",", F.when(context != "", F.concat(F.lit("context:"), context)), F.when(fast, "speed:fast"))


def resolve_models(names: DataFrame, models: DataFrame, aliases: DataFrame, families: DataFrame, sentinels: tuple[str, ...] = ("<synthetic>", "unknown")) -> DataFrame:
    """raw, normalized, tags, model, step, estimated, window of each different ``raw`` name.

    Steps: the catalog's own name; an alias; an unstable alias; the longest catalog name that is a whole-segment prefix of the undated name, or
    has it as one; the first family in order whose word the name holds. All but the first two are estimates, and so is a model that the catalog
    marks as unverified. ``models``: model, window, verified; ``aliases``: alias, model, stable; ``families``: place, word, model. The tables
    of names are joined by equal keys: each name by all its prefixes against each model by all of its own.
    """
    raw = names.select("raw").distinct()
    ids = raw.withColumn("id", tx.normalize_model(F.coalesce("raw", F.lit("unknown")))).withColumn("tags", F.coalesce(model_tags(F.col("raw")), F.lit("")))
    ids = ids.withColumn("synthetic", F.coalesce("raw", F.lit("unknown")).isin(*sentinels) | F.col("id").isin(*sentinels))
    real = ids.filter("not synthetic")
    dateless = real.select("id", F.regexp_replace("id", r"-\d{8}$", "").alias("stem")).distinct()
    shorter = dateless.select("id", F.explode(dash_prefixes(F.col("stem"))).alias("model"))
    longer = models.select(F.col("model"), F.explode(dash_prefixes(F.col("model"))).alias("stem"))
    close = shorter.join(models.select("model"), "model").select("id", "model").unionByName(dateless.join(longer, "stem").select("id", "model"))
    by_prefix = close.select("id", F.col("model"), F.length("model").alias("size"))
    # Families are few words; each name looks for the first of them.
    word = families.filter(F.col("model").isNotNull()).join(models.select("model"), "model", "left_semi").agg(F.array_sort(F.collect_list(F.struct("place", "word", "model"))).alias("f"))
    by_family = dateless.select("id").distinct().join(F.broadcast(word)).select("id", F.get(F.filter("f", lambda x: F.contains(F.col("id"), x["word"])), F.lit(0))["model"].alias("model")).filter("model is not null")
    known = aliases.join(models.select("model"), "model", "left_semi")
    steps = [
        ("exact", models.select(F.col("model").alias("id"), "model"), {"id": F.col("id")}, ["model"]), ("alias", known.filter("stable").select(F.col("alias").alias("id"), "model"), {"id": F.col("id")}, ["model"]),
        ("unstable", known.filter("not stable").select(F.col("alias").alias("id"), "model"), {"id": F.col("id")}, ["model"]), ("prefix", by_prefix, {"id": F.col("id")}, [F.col("size").desc(), "model"]), ("family", by_family, {"id": F.col("id")}, ["model"]),
    ]
    found = core.first_match(real, steps, ["model"]).unionByName(ids.filter("synthetic"), allowMissingColumns=True)
    out = found.join(models.select(F.col("model").alias("m"), "window", "verified"), F.col("model") == F.col("m"), "left")
    estimated = ~F.col("synthetic") & (F.col("model").isNull() | ~F.coalesce(F.col("step").isin("exact", "alias"), F.lit(False)) | ~F.coalesce("verified", F.lit(True)))
    return out.select("raw", F.col("id").alias("normalized"), "tags", "model", "step", estimated.alias("estimated"), "window")


MODELS = (("large-4", 200_000, True), ("large-4-1-20250805", 200_000, True), ("small-3", 100_000, True), ("small-3-5", 200_000, False), ("tiny", 50_000, True), ("tiny-2-20240101", 64_000, True))
ALIASES = (("big", "large-4", True), ("newest", "small-3-5", False), ("lost", "gone", True))
FAMILIES = ((1, "mega", "gone"), (2, "large", "large-4"), (3, "small", "small-3"), (4, "arg", "tiny"))
#: raw names by what they should hit.
RAW = (
    "large-4", "us.vendor.large-4-20250101-v1:0", "Large-4[1m]", "large-4-fast", "big", "newest", "lost", "large-4-1", "large-4-1-20250805", "large-4-1-20240101", "small-3-7-20250101", "small-3-5-20250101", "small", "tiny-2", "tiny-9", "extralarge-9", "mega-large", "megasmall",
    "other", "<synthetic>", "small-3-50", "tin", "cargo",
)


def model_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of conversations; a conversation's raw name is given by its number."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("conv_id is not null").select("conv_id").distinct()
    at = F.pmod("conv_id", F.lit(len(RAW) + 1)).cast("int")
    used = conv.withColumn("raw", F.get(F.array(*[F.lit(r) for r in RAW]), at))
    tables = (spark.createDataFrame(MODELS, "model string, window int, verified boolean"), spark.createDataFrame(ALIASES, "alias string, model string, stable boolean"), spark.createDataFrame(FAMILIES, "place int, word string, model string"))
    sums = used.groupBy("raw").agg(F.count("*").alias("conversations"))
    return resolve_models(used, *tables).alias("r").join(sums.alias("s"), F.col("r.raw").eqNullSafe(F.col("s.raw"))).select("r.*", "conversations")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# ---- agents


def spawns_and_agents(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that start agents (session_id, ord, turn_index, main, spawned, name, team), and the agents' own files (session_id, agent, name, team, place, start).

    Of the calls one third tells the agent's id, one third a name and a team (every other team wrong), one third a name alone.
    """
    c = bound_calls(events).filter("tool = 'Task'")
    kind = F.col("ord") % 3
    spawns = c.select(
        "session_id", "ord", "turn_index", F.col("agent_id").isNull().alias("main"), F.when(kind == 0, F.concat(F.lit("ag"), "ord")).alias("spawned"), F.when(kind != 0, F.concat(F.lit("n"), F.col("ord") % 7)).alias("name"),
        F.when(kind == 1, F.concat(F.lit("t"), F.col("ord") % 4)).alias("team"),
    )
    agents = c.filter("ord % 5 <> 4").select("session_id", F.concat(F.lit("ag"), "ord").alias("agent"), F.concat(F.lit("n"), F.col("ord") % 7).alias("name"), F.concat(F.lit("t"), F.col("ord") % 2).alias("team"), F.col("ord").alias("place"), (F.col("at") + (F.col("ord") % 9) * 60_000 - 200_000).alias("start"))
    return spawns, agents


def agent_links(events: DataFrame) -> DataFrame:
    """Each starting call with its agent: by id, else by name and team (the last such agent), else by name alone (the first)."""
    spawns, agents = spawns_and_agents(events)
    s = F.col("session_id")
    steps = [
        ("id", agents, {"session_id": s, "agent": F.col("spawned")}, ["place"]), ("name and team", agents, {"session_id": s, "name": F.col("name"), "team": F.col("team")}, [F.col("place").desc()]), ("name", agents, {"session_id": s, "name": F.col("name")}, ["place"]),
    ]
    return core.first_match(spawns, steps, ["agent"])


def agent_turns(events: DataFrame) -> DataFrame:
    """Each agent with its turn: of the first main call that started it, else the first whose time holds its start, else the last one begun before."""
    _, agents = spawns_and_agents(events)
    links = agent_links(events).filter("main and agent is not null").select("session_id", "agent", "ord", "turn_index")
    turns = bound_calls(events).groupBy("session_id", "turn_index").agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("duration_ms")).alias("to"))
    at = agents.withColumn("same", F.col("start"))
    within = core.interval_overlap_join(at.select("session_id", "agent", "start", "same"), turns, ["session_id"], ("start", "same"), ("from", "to"), 600_000).select("session_id", "agent", "turn_index")
    before = core.asof_join(agents.select("session_id", "agent", "start"), turns, ["session_id"], "start", "from", ["turn_index"]).select("session_id", "agent", "turn_index").filter("turn_index is not null")
    key = {"session_id": F.col("session_id"), "agent": F.col("agent")}
    return core.first_match(agents.select("session_id", "agent", "start"), [("call", links, key, ["ord"]), ("within", within, key, ["turn_index"]), ("before", before, key, ["turn_index"])], ["turn_index"])


_AGENTS = CALLS + """,
sp AS (SELECT session_id, ord, turn_index, agent_id IS NULL AS main, CASE WHEN ord % 3 = 0 THEN concat('ag', ord) END AS spawned, CASE WHEN ord % 3 <> 0 THEN concat('n', ord % 7) END AS name, CASE WHEN ord % 3 = 1 THEN concat('t', ord % 4) END AS team FROM w WHERE kind = 'Task'),
agents AS (SELECT session_id, concat('ag', ord) AS agent, concat('n', ord % 7) AS name, concat('t', ord % 2) AS team, ord AS place, ms + (ord % 9) * 60000 - 200000 AS start FROM w WHERE kind = 'Task' AND ord % 5 <> 4),
c1 AS (SELECT sp.*, (SELECT agent FROM agents a WHERE a.session_id = sp.session_id AND a.agent = sp.spawned) AS by_id, (SELECT arg_max(agent, place) FROM agents a WHERE a.session_id = sp.session_id AND a.name = sp.name AND a.team = sp.team) AS by_both,
  (SELECT arg_min(agent, place) FROM agents a WHERE a.session_id = sp.session_id AND a.name = sp.name) AS by_name FROM sp),
links AS (SELECT session_id, ord, turn_index, main, spawned, name, team, coalesce(by_id, by_both, by_name) AS agent, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_both IS NOT NULL THEN 'name and team' WHEN by_name IS NOT NULL THEN 'name' END AS step FROM c1)"""
_events = lambda f: lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"))
QUERIES = {"model_resolution": model_resolution, "agent_links": _events(agent_links), "agent_turn_links": _events(agent_turns)}
ORACLE = {
    "agent_links": _AGENTS + " SELECT * FROM links",
    "agent_turn_links": _AGENTS + """, turns AS (SELECT session_id, turn_index, min(ms) AS a, max(ms + duration_ms) AS z FROM w GROUP BY ALL),
x AS (SELECT session_id, agent, start, (SELECT arg_min(turn_index, ord) FROM links l WHERE l.session_id = g.session_id AND l.agent = g.agent AND main) AS c, (SELECT min(turn_index) FROM turns t WHERE t.session_id = g.session_id AND start BETWEEN a AND z) AS i,
  (SELECT arg_max(turn_index, a) FROM turns t WHERE t.session_id = g.session_id AND a <= start) AS b FROM agents g)
SELECT session_id, agent, start, coalesce(c, i, b) AS turn_index, CASE WHEN c IS NOT NULL THEN 'call' WHEN i IS NOT NULL THEN 'within' WHEN b IS NOT NULL THEN 'before' END AS step FROM x""",
    "model_resolution": f"""
WITH m(model, win, verified) AS (VALUES {_values(MODELS)}), al(alias, model, stable) AS (VALUES {_values(ALIASES)}), fam(place, word, model) AS (VALUES {_values(FAMILIES)}), raws(k, raw) AS (VALUES {_values(enumerate(RAW))}),
u AS (SELECT raw, count(*) AS conversations FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) LEFT JOIN raws ON k = conv_id % {len(RAW) + 1} GROUP BY raw),
n AS (SELECT *, CASE WHEN raw IS NULL THEN 'unknown' WHEN raw LIKE 'us.%' THEN 'large-4' ELSE regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\[1m\\]$', ''), '-[0-9]{{8}}$', ''), '-fast$', '') END AS id FROM u),
p AS (SELECT *, regexp_replace(id, '-[0-9]{{8}}$', '') AS stem FROM n),
f AS (SELECT *, coalesce(raw, 'unknown') IN ('<synthetic>', 'unknown') AS syn, (SELECT model FROM m WHERE m.model = id) AS e, (SELECT model FROM al WHERE alias = id AND stable AND model IN (SELECT model FROM m)) AS a, (SELECT model FROM al WHERE alias = id AND NOT stable) AS s,
  (SELECT model FROM m WHERE m.model = stem OR starts_with(m.model, stem || '-') OR starts_with(stem, m.model || '-') ORDER BY length(m.model) DESC, m.model LIMIT 1) AS x, (SELECT model FROM fam WHERE contains(id, word) AND model IN (SELECT model FROM m) ORDER BY place LIMIT 1) AS y FROM p),
g AS (SELECT *, CASE WHEN NOT syn THEN coalesce(e, a, s, x, y) END AS model, CASE WHEN syn THEN NULL WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' WHEN s IS NOT NULL THEN 'unstable' WHEN x IS NOT NULL THEN 'prefix' WHEN y IS NOT NULL THEN 'family' END AS step FROM f)
SELECT raw, id AS normalized, CASE WHEN raw = 'Large-4[1m]' THEN 'context:1m' WHEN raw = 'large-4-fast' THEN 'speed:fast' ELSE '' END AS tags, g.model AS model, step, NOT syn AND (g.model IS NULL OR step NOT IN ('exact', 'alias') OR NOT coalesce(verified, true)) AS estimated, win AS "window", conversations
FROM g LEFT JOIN m ON m.model = g.model""",
}
