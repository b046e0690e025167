"""Shell calls of sessions: their segments, what came of them, and the instructions that they break.

``conversations`` gives the calls: each assistant turn runs one of ``SHAPES``. The SQL knows no shell: what each shape comes to
is written beside it by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shell
from ..functions import text as tx

#: (command, its segments as (text, as it stands, program, variables, purpose, action, message)); {n} is a digit.
SHAPES = (
    ("git commit -m \"part {n}; tests pass && done\" && git push", (("git commit -m ''", "git commit -m \"part {n}; tests pass && done\"", "git", "", "none", "commit", "part {n}; tests pass && done"), ("git push", "git push", "git", "", "none", None, None))),
    ("cat <<'EOF' > n{n}.md && npx tsc --noEmit\nnpm ci; rm -rf x\nEOF", (("cat > n{n}.md", "cat <<'EOF' > n{n}.md", "cat", "", "none", None, None), ("npx tsc --noEmit", "npx tsc --noEmit", "npx", "", "build", None, None))),
    ("# don't stop\nnpm ci\necho 'done; {n}'", (("npm ci", "npm ci", "npm", "", "none", None, None), ("echo ''", "echo 'done; {n}'", "echo", "", "none", None, None))),
    ("CI=1 NODE_ENV=test npm run test:{n}", (("CI=1 NODE_ENV=test npm run test:{n}", "CI=1 NODE_ENV=test npm run test:{n}", "npm", "CI,NODE_ENV", "none", None, None),)),
    ("export CI=1; npm ci", (("export CI=1", "export CI=1", "export", "CI", "none", None, None), ("npm ci", "npm ci", "npm", "", "none", None, None))),
    ("(cd p{n} && pytest -q -k \"a or b\") | tail -{n}", (("cd p{n}", "cd p{n}", "cd", "", "none", None, None), ("pytest -q -k '')", "pytest -q -k \"a or b\")", "pytest", "", "test", None, None), ("tail -{n}", "tail -{n}", "tail", "", "none", None, None))),
    ("grep -rn jest src | wc -l", (("grep -rn jest src", "grep -rn jest src", "grep", "", "none", None, None), ("wc -l", "wc -l", "wc", "", "none", None, None))),
    ("bash ~/hooks/run{n}.sh --fast=1 \"$(pwd)\"", (("bash ~/hooks/run{n}.sh --fast=1 ''", "bash ~/hooks/run{n}.sh --fast=1 \"$(pwd)\"", "run{n}.sh", "", "none", None, None),)),
    ("make test || make -j{n} all", (("make test", "make test", "make", "", "test", None, None), ("make -j{n} all", "make -j{n} all", "make", "", "build", None, None))),
    ("gh pr create --title 'part {n}' --body \"it's; done\"", (("gh pr create --title '' --body ''", "gh pr create --title 'part {n}' --body \"it's; done\"", "gh", "", "none", "pr", None),)),
    ("git push --force origin b{n}", (("git push --force origin b{n}", "git push --force origin b{n}", "git", "", "none", None, None),)),
    ("echo it's {n}; npm ci # last", (("echo it's {n}", "echo it's {n}", "", "", "none", None, None), ("npm ci # last", "npm ci # last", "npm", "", "none", None, None))),
    ("pnpm npm ci && yarn run build", (("pnpm npm ci", "pnpm npm ci", "pnpm", "", "none", None, None), ("yarn run build", "yarn run build", "yarn", "", "build", None, None))),
    ("git   commit\t-am 'wip' ;; cargo  check", (("git commit -am ''", "git   commit\t-am 'wip'", "git", "", "none", "commit", None), ("cargo check", "cargo  check", "cargo", "", "build", None, None))),
    ("$(which py) -m x{n}; `date`", (("$(which py) -m x{n}", "$(which py) -m x{n}", "", "", "none", None, None), ("`date`", "`date`", "", "", "none", None, None))),
    ("python3 -m pytest t{n} | tee log && tsc --version", (("python3 -m pytest t{n}", "python3 -m pytest t{n}", "python3", "", "test", None, None), ("tee log", "tee log", "tee", "", "none", None, None), ("tsc --version", "tsc --version", "tsc", "", "none", None, None))),
    ("npm cite {n}", (("npm cite {n}", "npm cite {n}", "npm", "", "none", None, None),)),
)
#: (line of an instruction file, what it forbids).
RULES = (
    ("Never run `npm ci` here.", (("npm ci", "command"),)), ("Do not use `--force`.", (("--force", "flag"),)), ("Use `pnpm`, not `git push`, and avoid `make`.", (("make", "command"), ("git push", "command"))),
    ("Speak plainly.", ()), ("Don't call `Bash`.", (("Bash", "tool"),)),
)
#: Words after which a command stands as well as alone.
RUNNERS = ("npx ", "npm run ", "npm exec ", "pnpm run ", "pnpm exec ", "pnpm dlx ", "pnpm ", "yarn run ", "yarn dlx ", "yarn ", "bunx ", "bun run ", "bun x ")
ENV_ONLY = r"^(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*=\S*(?:\s+[A-Za-z_][A-Za-z0-9_]*=\S*)*$"


def shell_calls(conversations: DataFrame) -> DataFrame:
    """session, turn, is_error, command of each assistant turn."""
    shapes = F.array(*[F.lit(c) for c, _ in SHAPES])
    command = F.get(shapes, F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(SHAPES))).cast("int"))
    rows = conversations.filter("role = 'assistant' and conv_id is not null and turn is not null")
    return rows.select(F.col("conv_id").alias("session"), "turn", ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("is_error"), F.replace(command, F.lit("{n}"), (F.col("conv_id") % 10).cast("string")).alias("command"))


def segments(conversations: DataFrame) -> DataFrame:
    return shell.exploded(shell_calls(conversations), "command")


def outcomes(conversations: DataFrame) -> DataFrame:
    """Of each session: test and build calls and those that failed, commits that went well, the last one's message, pull requests."""
    s = segments(conversations)
    call = s.groupBy("session", "turn", "is_error").agg(
        F.bool_or(F.col("purpose") == "test").alias("test"), F.bool_or(F.col("purpose") == "build").alias("build"), F.bool_or(F.coalesce(F.col("action") == "commit", F.lit(False))).alias("commit"),
        F.bool_or(F.coalesce(F.col("action") == "pr", F.lit(False))).alias("pr"), F.min_by("message", F.when(F.col("message").isNotNull(), F.col("n"))).alias("message"),
    )
    build, ok = F.col("build") & ~F.col("test"), ~F.col("is_error")
    n = lambda c: F.count(F.when(c, 1))
    return call.groupBy("session").agg(
        n(F.col("test")).alias("tests"), n(F.col("test") & F.col("is_error")).alias("tests_failed"), n(build).alias("builds"), n(build & F.col("is_error")).alias("builds_failed"), n(F.col("commit") & ok).alias("commits"), n(F.col("pr") & ok).alias("prs"),
        F.max_by("message", F.when(F.col("commit") & ok, F.col("turn"))).alias("last_message"), F.max_by(ok, F.when(F.col("test"), F.col("turn"))).alias("last_test_passed"),
    )


def rule_lines(conversations: DataFrame) -> DataFrame:
    """session, since (turn at which the file is loaded), line."""
    lines = F.array(*[F.lit(line) for line, _ in RULES])
    each = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("session")).distinct()
    return each.select("session", (F.col("session") % 3).alias("since"), F.get(lines, F.pmod("session", F.lit(len(RULES))).cast("int")).alias("line"))


def violations(conversations: DataFrame) -> DataFrame:
    """Of each rule in force: calls from its loading on that break it, those that failed, the first turn, an example.

    A command breaks a rule if a segment begins with what the rule forbids, or with one runner and then it. Behind a segment that
    only sets variables no command of the call counts, as with variables in front.
    """
    rules = rule_lines(conversations).select("session", "since", "line", F.explode(tx.forbidden_targets(F.col("line"))).alias("target")).withColumn("kind", tx.target_kind(F.col("target")))
    calls = shell_calls(conversations).drop("command").withColumn("tool", F.lit("Bash"))
    s = segments(conversations)
    only = F.col("segment").rlike(ENV_ONLY)
    env = s.groupBy("session", "turn").agg(F.min(F.when(only, F.col("n"))).alias("set_at"))
    s = s.filter(~only).join(env, ["session", "turn"])
    after = lambda text: text.startswith(F.col("target")) & F.regexp_like(F.concat(F.substr(text, F.length("target") + 1), F.lit(" ")), F.lit("^[\\s)}'\"]"))
    begins = after(F.col("segment"))
    for r in RUNNERS:
        begins = begins | (F.col("segment").startswith(r) & after(F.substr("segment", F.lit(len(r) + 1))))
    flag = F.exists(F.split("segment", " "), lambda w: (w == F.col("target")) | w.startswith(F.concat(F.col("target"), F.lit("="))))
    hit = F.when(F.col("kind") == "command", begins & (F.col("set_at").isNull() | (F.col("n") < F.col("set_at")))).otherwise(flag)
    by_segment = rules.filter("kind <> 'tool'").join(s, "session").filter((F.col("turn") >= F.col("since")) & hit)
    by_segment = by_segment.groupBy("session", "line", "target", "kind", "turn", "is_error").agg(F.min_by(F.when(F.col("kind") == "command", F.col("segment")).otherwise(F.concat_ws(" ", "program", "target")), "n").alias("example"))
    by_tool = rules.filter("kind = 'tool'").join(calls, "session").filter((F.col("turn") >= F.col("since")) & (F.col("tool") == F.col("target"))).select("session", "line", "target", "kind", "turn", "is_error", F.col("tool").alias("example"))
    found = by_segment.unionByName(by_tool).groupBy("session", "line", "target").agg(F.count("*").alias("calls"), F.count(F.when(F.col("is_error"), 1)).alias("failed"), F.min("turn").alias("first_turn"), F.min_by("example", "turn").alias("example"))
    return rules.join(found, ["session", "line", "target"], "left").select("session", "since", "line", "target", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "failed")], "first_turn", "example")


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


_EXPECTED = f"""
WITH shape(k, command) AS (VALUES {", ".join(f"({k}, {_text(c)})" for k, (c, _) in enumerate(SHAPES))}),
part(k, n, segment, raw, program, variables, purpose, action, message) AS (VALUES {", ".join(f"({k}, {n}, {', '.join(_text(x) for x in row)})" for k, (_, rows) in enumerate(SHAPES) for n, row in enumerate(rows))}),
calls AS (SELECT conv_id AS session, turn, (conv_id + turn) % 4 = 0 AS is_error, (conv_id * 7 + turn) % {len(SHAPES)} AS k, (conv_id % 10)::VARCHAR AS d FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
seg AS (SELECT session, turn, is_error, n, replace(segment, '{{n}}', d) AS segment, strpos(replace(command, '{{n}}', d), replace(raw, '{{n}}', d)) - 1 AS start, length(replace(raw, '{{n}}', d)) AS len, replace(program, '{{n}}', d) AS program, variables, purpose, action, replace(message, '{{n}}', d) AS message
  FROM calls JOIN shape USING (k) JOIN part USING (k))"""
_WORDS = "'^(?:" + "|".join(RUNNERS) + ")?'"

QUERIES = {name: (lambda spark, sf_dir, f=f: f(spark.read.parquet(f"{sf_dir}/conversations.parquet"))) for name, f in (("shell_segments", segments), ("shell_outcomes", outcomes), ("instruction_violations", violations))}
ORACLE = {
    "shell_segments": _EXPECTED + " SELECT session, turn, is_error, n, segment, start::INT AS start, (start + len)::INT AS stop, program, variables, purpose, action, message FROM seg",
    "shell_outcomes": _EXPECTED + """, c AS (SELECT session, turn, is_error, count(CASE WHEN purpose = 'test' THEN 1 END) > 0 AS t, count(CASE WHEN purpose = 'build' THEN 1 END) > 0 AS b, count(CASE WHEN action = 'commit' THEN 1 END) > 0 AS c, count(CASE WHEN action = 'pr' THEN 1 END) > 0 AS p, any_value(message) AS m FROM seg GROUP BY ALL)
SELECT session, count(*) FILTER (t) AS tests, count(*) FILTER (t AND is_error) AS tests_failed, count(*) FILTER (b AND NOT t) AS builds, count(*) FILTER (b AND NOT t AND is_error) AS builds_failed, count(*) FILTER (c AND NOT is_error) AS commits, count(*) FILTER (p AND NOT is_error) AS prs,
 (SELECT l.m FROM c l WHERE l.session = c.session AND l.c AND NOT l.is_error ORDER BY l.turn DESC LIMIT 1) AS last_message, (SELECT NOT l.is_error FROM c l WHERE l.session = c.session AND l.t ORDER BY l.turn DESC LIMIT 1) AS last_test_passed FROM c GROUP BY session""",
    "instruction_violations": _EXPECTED + f""", r0(k, line, target, kind) AS (VALUES {", ".join(f"({k}, {_text(line)}, {_text(t)}, {_text(kind)})" for k, (line, targets) in enumerate(RULES) for t, kind in targets)}),
r AS (SELECT DISTINCT conv_id AS session, conv_id % 3 AS since, line, target, kind FROM conversations JOIN r0 ON r0.k = conv_id % {len(RULES)}),
h AS (SELECT r.*, turn, is_error, n, CASE kind WHEN 'command' THEN segment ELSE concat_ws(' ', program, target) END AS example FROM r JOIN seg USING (session) WHERE turn >= since AND CASE kind
  WHEN 'command' THEN regexp_matches(segment, {_WORDS} || regexp_escape(target) || '(?:[\\s)}}''"]|$)') AND NOT starts_with(segment, 'export ') AND NOT EXISTS (FROM seg e WHERE e.session = seg.session AND e.turn = seg.turn AND e.n < seg.n AND e.segment = 'export CI=1')
  WHEN 'flag' THEN list_contains(string_split(segment, ' '), target) ELSE false END
 UNION ALL SELECT r.*, turn, is_error, 0, target FROM r JOIN calls USING (session) WHERE kind = 'tool' AND turn >= since),
g AS (SELECT session, line, target, count(DISTINCT turn) AS calls, count(DISTINCT CASE WHEN is_error THEN turn END) AS failed, min(turn) AS first_turn, arg_min(example, turn * 100 + n) AS example FROM h GROUP BY ALL)
SELECT session, since, line, target, kind, coalesce(calls, 0) AS calls, coalesce(failed, 0) AS failed, first_turn, example FROM r LEFT JOIN g USING (session, line, target)""",
}
