"""Operator 5: benchmark decontamination by spaced seeds. DataFrame functions only.

Texts become tokens (lower-cased runs of letters and digits), tokens become hashes. A seed is a window
of ``SPAN`` tokens under a fixed mask that ignores some of its positions, so that a replaced word still
leaves seeds that match. Seeds of test items and of documents are joined; hits of one document and item
fall on diagonals (document position minus item position). Around the hits of each diagonal the tokens
are compared and the best run is taken, a match counting 1 and a substitution -``penalty``. A run is a
leak if it matches ``min_tokens`` tokens or more, or ``min_share`` of a shorter item; so is a diagonal on
which ``min_share`` of the item's tokens stand in their places, whatever is replaced between them.

The documents' windows stay in generated code from the explode to the probe. The item seeds are sent to
all tasks only while they number at most ``broadcast_rows``; more are joined by shuffle. Only documents
with hits are read again for the comparison.

Null and empty texts have no seeds, as texts and items of fewer than ``SPAN`` tokens. Repeated rows of
documents or items with the same id and text give one row. A null doc_id or item_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPAN = 10
#: The positions that each mask compares.
MASKS = ((0, 1, 2, 3, 4, 5, 6), (0, 1, 3, 4, 6, 8, 9), (0, 2, 3, 5, 6, 7, 9), (0, 1, 2, 5, 7, 8, 9), (0, 1, 2, 6, 7, 8, 9))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(tokenized: DataFrame, keep: list[str]) -> DataFrame:
    """One row per window and mask: ``keep``, at, seed. ``tokenized`` has the hashes in ``hw``."""
    windows = tokenized.select(*keep, "hw", F.explode(F.sequence(F.lit(0), F.size("hw") - SPAN)).alias("at"))
    seeds = [F.xxhash64(F.lit(k), *[F.get("hw", F.col("at") + i) for i in mask]) for k, mask in enumerate(MASKS)]
    return windows.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed"))


def _best_run(doc: Column, item: Column, penalty: int) -> Column:
    """Best run of two token arrays laid side by side: score, start, end (exclusive)."""
    steps = F.zip_with(doc, item, lambda a, b: F.when(a == b, 1).otherwise(-penalty))
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("now"), F.lit(0).alias("begin"), F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(acc["now"] > 0, acc["now"] + x).otherwise(x)
        begin = F.when(acc["now"] > 0, acc["begin"]).otherwise(acc["k"])
        better = now > acc["score"]
        return F.struct(
            (acc["k"] + 1).alias("k"), now.alias("now"), begin.alias("begin"), F.when(better, now).otherwise(acc["score"]).alias("score"),
            F.when(better, begin).otherwise(acc["start"]).alias("start"), F.when(better, acc["k"] + 1).otherwise(acc["end"]).alias("end"),
        )

    return F.aggregate(steps, start, step)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = 13,
    min_share: float = 0.8,
    penalty: int = 3,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), item_id, doc_start, doc_end, item_start (tokens), n_matched, n_aligned, n_item, n_seeds of the best run of each pair, and n_equal, the most tokens in place on one diagonal."""
    tests = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    tests = tests.withColumn("iw", F.transform(tokens(F.col("item_text")), lambda x: F.xxhash64(x))).filter(F.size("iw") >= SPAN)
    tests = tests.select("item_id", F.xxhash64("item_text").alias("ih"), F.col("iw").alias("hw"))
    seeds = materialize(_seeds(tests, ["item_id", "ih"]).withColumnRenamed("at", "p"), "item-seeds")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    enough = F.octet_length("text") >= 2 * SPAN - 1
    hashed = rows.filter(enough).select("doc_id", F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("w")).select("doc_id", "th", F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    found = _seeds(hashed.filter(F.size("hw") >= SPAN), ["doc_id", "th"])
    probe = F.broadcast(seeds) if seeds.count() <= broadcast_rows else seeds
    # Hits are summed per diagonal before they move.
    hits = (
        found.join(probe, "seed").groupBy("doc_id", "th", "item_id", "ih", (F.col("at") - F.col("p")).alias("diagonal")).agg(F.count("*").alias("n_seeds"))
    )
    hits = materialize(hits, "seed-hits")
    wanted = hits.select("doc_id", "th").distinct()
    small = hits.count() <= broadcast_rows
    same = F.col("d.th").eqNullSafe(F.col("h.th")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    texts = rows.withColumn("th", F.xxhash64("text")).alias("d").join((F.broadcast(wanted) if small else wanted).alias("h"), same, "left_semi")
    texts = texts.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("dw"))
    aligned = hits.alias("h").join(texts.alias("d"), same).join(
        tests.select(F.col("item_id").alias("tid"), F.col("ih").alias("tih"), F.col("hw").alias("iw")), F.col("h.item_id").eqNullSafe(F.col("tid")) & (F.col("h.ih") == F.col("tih"))
    )
    first = F.greatest(-F.col("diagonal"), F.lit(0))  # of the item
    length = F.least(F.size("iw") - first, F.size("dw") - F.col("diagonal") - first)
    aligned = aligned.select("h.doc_id", "h.th", "h.item_id", "h.ih", "n_seeds", "diagonal", F.size("iw").alias("n_item"), first.alias("first"), F.slice("dw", F.col("diagonal") + first + 1, length).alias("a"), F.slice("iw", first + 1, length).alias("b"))
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x)).cast("long")
    run = aligned.withColumn("n_equal", equal).withColumn("run", _best_run(F.col("a"), F.col("b"), penalty))
    run = run.select("doc_id", "th", "item_id", "ih", "n_item", "n_equal", F.struct(
        F.expr("(run.score + %d * (run.end - run.start)) div %d" % (penalty, penalty + 1)).alias("n_matched"), (F.col("run.end") - F.col("run.start")).cast("long").alias("n_aligned"),
        (-(F.col("diagonal") + F.col("first") + F.col("run.start"))).alias("minus_start"), (F.col("first") + F.col("run.start")).alias("item_start"), "n_seeds",
    ).alias("best"))
    best = run.groupBy("doc_id", "th", "item_id", "ih", "n_item").agg(F.max("best").alias("best"), F.max("n_equal").alias("n_equal"))
    best = best.select("doc_id", F.col("th").alias("text_hash"), "item_id", (-F.col("best.minus_start")).cast("long").alias("doc_start"), (-F.col("best.minus_start") + F.col("best.n_aligned")).cast("long").alias("doc_end"),
                       F.col("best.item_start").cast("long").alias("item_start"), F.col("best.n_matched").cast("long").alias("n_matched"), "best.n_aligned", F.col("n_item").cast("long").alias("n_item"), F.col("best.n_seeds").alias("n_seeds"), "n_equal")
    return best.filter((F.col("n_matched") >= min_tokens) | (F.greatest("n_matched", "n_equal") >= min_share * F.col("n_item")))
