"""Generic operators; keys, orders and column names are arguments. Ties are broken by the order given."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def running_index(df: DataFrame, keys: list[str], order: list, flag: Column, name: str = "turn_index") -> DataFrame:
    """Number of flagged rows up to each row, from 0; rows before the first get -1."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.sum(F.when(flag, 1).otherwise(0)).over(w) - 1).cast("int"))


def dealt(df: DataFrame, keys: list[str], rows: int, each: int = 50_000) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its ``rows`` need at ``each`` a task, so that a task's sorts do not grow with the table.

    Windows and groups by ``keys`` (and more) need no further exchange. The number is given, so adaptive execution does not join tasks.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(_over(keys, order))).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(_over(keys, order))).filter(F.col(rank) <= k)


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, name: str = "union_ms") -> DataFrame:
    """Length of the union of each key's spans. Touching spans are one; spans that end early are dropped."""
    df = df.filter(F.col(end) >= F.col(start))
    before = _over(keys, [start, end]).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    df = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(_over(keys, [start, end]).rowsBetween(Window.unboundedPreceding, 0)))
    islands_ = df.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_len"))
    return islands_.groupBy(*keys).agg(F.sum("_len").alias(name), F.count("*").alias("islands"))


def concurrency_sweep(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most spans open at once and the time covered by at least one; at equal times an end comes first."""
    df = df.filter(F.col(end) >= F.col(start))
    marks = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.t", "m.d")
    steps = marks.groupBy(*keys, "t", "d").agg(F.sum("d").alias("s"))
    w = _over(keys, ["t", "d"])
    steps = steps.withColumn("open", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("t").over(w))
    return steps.groupBy(*keys).agg(F.max("open").alias("max_concurrent"), F.sum(F.when(F.col("open") > 0, F.coalesce(F.col("next") - F.col("t"), F.lit(0))).otherwise(0)).alias("covered_ms"))


def islands(df: DataFrame, keys: list[str], order: list, flag: Column, min_len: int) -> DataFrame:
    """Runs of consecutive flagged rows with at least ``min_len`` of them: keys, run, n, first and last order value."""
    o = order[0]
    df = df.withColumn("_f", F.when(flag, 1).otherwise(0)).withColumn("_g", F.sum(F.when(F.col("_f") == 0, 1).otherwise(0)).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.filter("_f = 1").groupBy(*keys, F.col("_g").alias("run")).agg(F.count("*").alias("n"), F.min(o).alias("first"), F.max(o).alias("last"))
    return runs.filter(F.col("n") >= min_len)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward") -> DataFrame:
    """To each left row the values of the nearest right row: last one at or before, or (forward) first one at or after.

    One union and one window; no pair of rows is formed. Right rows of one key and time: the last by value.
    """
    cols = left.columns
    l = left.select(*cols, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(_payload(right, values)).alias("_v"))  # noqa: E741
    r = right.select(*[F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = l.union(r)
    if direction == "backward":
        w = _over(keys, ["_t", "_side", F.col("_v").asc_nulls_first()]).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = _over(keys, [F.col("_t").desc(), "_side", F.col("_v").asc_nulls_first()]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*cols, *[F.col(f"_hit.{v}").alias(v) for v in values])


def _payload(df: DataFrame, values: list[str]) -> str:
    return df.select(F.struct(*values).alias("v")).schema["v"].dataType.simpleString()


def interval_overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bin_ms: int) -> DataFrame:
    """Pairs of one key whose spans share a point. Spans are dealt out by time bin, a pair is kept in its first common bin."""
    def binned(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(span[0]) / bin_ms), F.floor(F.col(span[1]) / bin_ms))))

    x, y = binned(a.filter(F.col(a_span[1]) >= F.col(a_span[0])), a_span, "_bin"), binned(b.filter(F.col(b_span[1]) >= F.col(b_span[0])), b_span, "_bin")
    joined = x.join(y, [*keys, "_bin"])
    start = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    return joined.filter((start <= F.least(F.col(a_span[1]), F.col(b_span[1]))) & (F.floor(start / bin_ms) == F.col("_bin"))).drop("_bin")


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(p n); exact."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], buckets: int = 4096, rounds: int = 2) -> DataFrame:
    """keys, n (rows) and, per name of ``shares``, the value at rank ceil(p n) of those not null: ``nearest_rank`` for few keys with many values.

    In each round the span of values that holds a rank is cut into ``buckets``, which are counted, and only one of them goes on; the values
    of the last are ranked. So no task gathers a key's values. Exact however the values lie; NaN is the largest.
    """
    x = F.col("_x")
    rows = df.select(*keys, F.col(value).alias("_v"), F.col(value).cast("double").alias("_x"))
    usual = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_v").alias("_m"), F.min(F.when(usual, x)).alias("_lo"), F.max(F.when(usual, x)).alias("_hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()]))
    at = ends.filter("_m > 0").select(*keys, "_lo", "_hi", "_m", asked.alias("_p"))
    at = at.select(*keys, F.col("_p.name").alias("_name"), F.greatest(F.lit(1), F.ceil(F.col("_m") * F.col("_p.p"))).cast("long").alias("_rank"), "_lo", "_hi")
    place = F.when(x == -float("inf"), -1).when(~usual, buckets + 1).when(F.col("_hi") > F.col("_lo"), F.floor((x / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets)).otherwise(0).cast("int")
    path: list[str] = []
    same = lambda a, b, names: F.expr(" and ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in names))
    rows = rows.filter("_v is not null").alias("r")
    for k in range(rounds):
        on = [*keys, *path]
        spans = at.select(*on, "_lo", "_hi").distinct().alias("s")
        rows = rows.join(F.broadcast(spans), same("r", "s", on)).select("r.*", "s._lo", "s._hi").withColumn(f"_b{k}", place).drop("_lo", "_hi")
        counts = rows.groupBy(*on, f"_b{k}").agg(F.count("*").alias("_c"), F.min(F.when(usual, x)).alias("_lo"), F.max(F.when(usual, x)).alias("_hi"))
        counts = counts.withColumn("_upto", F.sum("_c").over(_over(on, [f"_b{k}"]).rowsBetween(Window.unboundedPreceding, 0))).alias("c")
        within = same("t", "c", on) & (F.col("t._rank") <= F.col("c._upto")) & (F.col("t._rank") > F.col("c._upto") - F.col("c._c"))
        at = at.drop("_lo", "_hi").alias("t").join(counts, within).select("t.*", f"c._b{k}", "c._lo", "c._hi", (F.col("c._upto") - F.col("c._c")).alias("_below"))
        at = at.withColumn("_rank", F.col("_rank") - F.col("_below")).drop("_below")
        path.append(f"_b{k}")
        rows = rows.alias("r")
    on = [*keys, *path]
    last = rows.join(F.broadcast(at.select(*on).distinct().alias("s")), same("r", "s", on), "left_semi").groupBy(*on, "_v").agg(F.count("*").alias("_c"))
    last = last.withColumn("_upto", F.sum("_c").over(_over(on, ["_v"]).rowsBetween(Window.unboundedPreceding, 0))).alias("c")
    found = at.alias("t").join(last, same("t", "c", on) & (F.col("t._rank") <= F.col("c._upto")) & (F.col("t._rank") > F.col("c._upto") - F.col("c._c"))).select(*[f"t.{k}" for k in keys], "t._name", "c._v")
    wide = found.groupBy(*keys).agg(*[F.first(F.when(F.col("_name") == name, F.col("_v")), ignorenulls=True).alias(name) for name in shares]).alias("f")
    return ends.alias("e").join(wide, same("e", "f", keys), "left").select(*[f"e.{k}" for k in keys], *[f"f.{name}" for name in shares], "e.n")


def rounded(x: Column, digits: int = 4) -> Column:
    """floor(x f + 0.5) / f, the same on every engine; null where x is null."""
    f = 10**digits
    return F.floor(x * f + 0.5) / f


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b == 0, 0.0).otherwise(rounded(a / b, digits))


def repeated_ngrams(df: DataFrame, keys: list[str], order: list, symbol: str, n: int, least: int) -> DataFrame:
    """keys, gram, count: occurrences of n consecutive symbols that do not overlap, taken greedily from the left."""
    w = _over(keys, order)
    parts = [F.lead(symbol, i).over(w) for i in range(n)]
    rows = df.filter(F.col(symbol).isNotNull()).withColumn("_p", F.row_number().over(w)).withColumn("_last", parts[-1]).withColumn("gram", F.concat_ws(" ", *parts)).filter("_last is not null")
    starts = rows.groupBy(*keys, "gram").agg(F.array_sort(F.collect_list("_p")).alias("at")).filter(F.size("at") >= least)
    empty = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("count"))
    greedy = F.aggregate("at", empty, lambda acc, p: F.when(p >= acc["last"] + n, F.struct(p.alias("last"), (acc["count"] + 1).alias("count"))).otherwise(acc))
    return starts.select(*keys, "gram", greedy["count"].cast("long").alias("count")).filter(F.col("count") >= least)


def week_spine(df: DataFrame, ts: str, weeks: int, aggregates: list[Column]) -> DataFrame:
    """The ``weeks`` ISO weeks that end at the last time seen, zero-filled."""
    summed = df.groupBy(F.date_trunc("week", ts).cast("date").alias("week")).agg(*aggregates)
    spine = summed.agg(F.max("week").alias("last")).select(F.explode(F.sequence(F.date_sub("last", 7 * (weeks - 1)), "last", F.expr("interval 7 days"))).alias("week"))
    return spine.join(summed, "week", "left").na.fill(0)


def bounded_rollup(findings: DataFrame, key: str, session: str, claim: str) -> DataFrame:
    """Per rule: sessions, bounded saving = least(sum, median x sessions), first five sessions and the largest claim among them."""
    per = findings.groupBy(key, session).agg(F.sum(claim).alias("_c"))
    first = top_k(per, [key], [session], 5).groupBy(key).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(F.col(session).alias("s")))), lambda x: x["s"])).alias("first_sessions"), F.max_by(session, F.struct("_c", -F.col("rank"))).alias("example"))
    total = per.groupBy(key).agg(F.count("*").alias("sessions"), F.sum("_c").alias("claimed"), F.percentile("_c", 0.5).alias("_m"))
    return total.join(first, key).select(key, "sessions", "claimed", F.floor(F.least(F.col("claimed").cast("double"), F.col("_m") * F.col("sessions")) + 0.5).cast("long").alias("bounded"), "first_sessions", "example")


def declared_vs_used(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Full outer join of declared names and counted uses: status used, idle or undeclared."""
    uses = used.groupBy(key).agg(F.count("*").alias("uses"))
    names = declared.select(key).distinct().withColumn("_d", F.lit(True))
    joined = names.join(uses, key, "full")
    return joined.select(key, F.when(F.col("_d").isNull(), "undeclared").when(F.col("uses").isNull(), "idle").otherwise("used").alias("status"), F.coalesce("uses", F.lit(0)).alias("uses"))


def prefix_under_budget(df: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows of each key as long as their running size fits, with the number of rows left out. The first too large row ends it."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    fits = df.withColumn("_s", F.sum(size).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    kept = fits.filter(F.col("_s") <= budget)
    return kept.withColumn("omitted", F.col("_n") - F.count("*").over(Window.partitionBy(*keys))).withColumnRenamed("_s", "running_size").drop("_n")


def status_moves(df: DataFrame, keys: list[str], order: list, status: str) -> DataFrame:
    """Rows at which the status changes, with the status before."""
    w = _over(keys, order)
    moved = df.withColumn("from_status", F.lag(status).over(w))
    return moved.filter(F.col("from_status").isNull() | (F.col("from_status") != F.col(status)))


def rank_test(before: list[float], after: list[float]) -> tuple[float, float]:
    """Exact Mann-Whitney test with midranks: the rank sum of ``after`` and the two-sided p, to 6 decimals.

    The number of ways to reach each doubled rank sum is counted; ties are as they stand.
    """
    values = sorted([*before, *after])
    doubled = {v: 2 * values.index(v) + values.count(v) + 1 for v in set(values)}
    ranks = [doubled[v] for v in [*before, *after]]
    observed, k = sum(doubled[v] for v in after), len(after)
    ways: list[dict[int, int]] = [{0: 1}] + [{} for _ in range(k)]
    for r in ranks:
        for size in range(k - 1, -1, -1):
            for s, n in ways[size].items():
                ways[size + 1][s + r] = ways[size + 1].get(s + r, 0) + n
    total = math.comb(len(ranks), k)
    low = sum(n for s, n in ways[k].items() if s <= observed)
    high = sum(n for s, n in ways[k].items() if s >= observed)
    return observed / 2, round(min(1.0, 2 * min(low, high) / total), 6)


def exact_rank_test(df: DataFrame, keys: list[str], side: str, value: str, order: list, most: int = 10) -> DataFrame:
    """Per key: n_before, n_after, rank_sum and p of the exact test. ``side``: 'before' or 'after', at most ``most`` rows each.

    The rows of a key are bounded by ``most``, so that a group in a task is, too.
    """
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["n_before long", "n_after long", "rank_sum double", "p double"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows[side] == "before"][value].tolist(), rows[rows[side] == "after"][value].tolist()
        s, p = rank_test(a, b) if a and b else (None, None)
        return pd.DataFrame([[*key, len(a), len(b), s, p]])

    small = top_k(df, [*keys, side], order, most, "_k").select(*keys, side, value)
    return small.groupBy(*keys).applyInPandas(run, schema)


def first_match(left: DataFrame, steps: list[tuple[str, DataFrame, dict[str, Column], list]], values: list[str], step: str = "step") -> DataFrame:
    """``left`` with ``values`` of the first step that has a partner for the row, and that step's name; null where none has.

    A step is (name, right, {right column: what it must equal in left}, order): of the right rows of one key the first in ``order`` counts.
    Each right side is brought to one row a key first, so that no join multiplies rows. Rows that have found a partner go through later
    joins by their own keys and match nothing; rows without a key are spread by a hash of their own instead of meeting in one task.
    """
    cols = left.columns
    kinds = {v: steps[0][1].schema[v].dataType.simpleString() for v in values}
    out = left.withColumns({"_found": F.lit(None).cast("struct<" + ", ".join(f"{v}: {t}" for v, t in kinds.items()) + ">"), step: F.lit(None).cast("string")})
    for n, (name, right, on, order) in enumerate(steps):
        keys = list(on)
        one = first_by(right.dropna(subset=keys), keys, order).select(*[F.col(k).alias(f"_k{k}") for k in keys], F.struct(*values).alias("_v"), F.pmod(F.xxhash64(*keys), F.lit(1)).alias("_kz"))
        lost = F.greatest(F.lit(False), *[c.isNull() for c in on.values()])
        out = out.withColumns({**{f"_l{k}": c for k, c in on.items()}, "_lz": F.when(lost, F.pmod(F.xxhash64(*cols), F.lit(4096))).otherwise(F.lit(0).cast("bigint"))})
        same = F.col("_found").isNull() & (F.col("_lz") == F.col("_kz"))
        for k in keys:
            same = same & (F.col(f"_l{k}") == F.col(f"_k{k}"))
        out = out.join(one, same, "left")
        out = out.select(*cols, F.coalesce("_found", "_v").alias("_found"), F.when(F.col("_found").isNull() & F.col("_v").isNotNull(), name).otherwise(F.col(step)).alias(step))
    return out.select(*cols, *[F.col(f"_found.{v}").alias(v) for v in values], step)
