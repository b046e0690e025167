"""Operator 10: quality rules with cross-document line frequency. DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated five-word windows give the base
verdict. Beside it lines are normalised (lower case, digits to 0, white space to one space) and hashed;
per host (``host_col``) the distinct documents of each line are counted, equal texts once. A line that
more than ``max_share`` of the host's distinct texts hold, and more than ``min_docs`` of them, is
boilerplate there, alike on hosts of every size (a caller may set ``max_docs``, which then suffice): it is removed everywhere but in its first document (smallest id), so that text
survives once. A document that passes the base rules is rejected as depleted if removal takes away a
line and leaves fewer than ``min_words`` words or less than ``min_left`` of its words.

Null text counts as empty: zero counts, base_failed. Null host is a host of its own. Equal rows get
equal results, one row out for each row in. A null id is kept and counts as the last id of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, words

SYMBOLS = "#*$%&|<>"


def base_counts(docs: DataFrame, text_col: str = "text", windows_of: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    line_words = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_w", words(F.col(text_col))).withColumn("_lines", line_words)
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hw": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    ).drop("_w", "_lines")
    window = lambda i: F.xxhash64(*[F.get("_hw", i + j) for j in range(windows_of)])
    starts = F.sequence(F.lit(0), F.size("_hw") - windows_of)
    df = df.withColumn("_win", F.when(F.size("_hw") >= windows_of, F.transform(starts, window))).drop("_hw")
    # Most texts repeat no window: only the others are sorted.
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    entry = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn("_sorted", F.when(repeats, F.array_sort(entry))).drop("_win")
    same = lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i)["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("_pos", F.array_sort(F.transform(twice, lambda x: x["p"]))).drop("_sorted")
    gaps = F.zip_with(F.expr("slice(_pos, 1, size(_pos) - 1)"), F.expr("slice(_pos, 2, size(_pos) - 1)"), lambda a, b: F.least(b - a, F.lit(windows_of)))
    covered = F.aggregate(gaps, F.lit(windows_of), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_pos")


def without_lines(text: Column, hashes: Column) -> Column:
    """A text without the lines whose normal form has one of the hashes. White space between the others stays."""
    norm = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " "))
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hashes, F.xxhash64(norm(x))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(left, "\n"))


def normalized_lines(text: Column) -> Column:
    """Hash, word count and number of each line with a word, each distinct line of a document once."""
    norm = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")), r" ?\n ?")
    return F.filter(norm, lambda x: x != "")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_pct: int = 20,
    min_docs: int = 20,
    max_share: float = 0.10,
    max_docs: int | None = None,
    min_left: float = 0.3,
    with_lines: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key (``row_key``), id, the five counts, n_removed_lines, n_left_words, base_failed, kept.

    A line's limit is ``max_share`` of the host's distinct texts, but at least ``min_docs`` and, where it
    is given, at most ``max_docs`` of them. ``with_lines`` adds common_lines, the hashes of
    the lines that a document loses (null if none), for ``without_lines``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col), F.lit("\x00null")).alias("host"))
    keyed = rows.withColumn("key", row_key("doc_id", "text"))
    # Grouping by the key keeps later filters on the counts from being pushed below and evaluated
    # there once more; the join below needs the rows by key anyway.
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = (
        base_counts(keyed.select("key", "doc_id", "text"), windows_of=5).drop("text")
        .groupBy("key").agg(F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in counts], F.count("*").alias("copies"))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    )
    # Hashed lines: one row for each distinct line of a document, with the words that it holds there.
    lines = (
        keyed.select("key", "host", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.explode(normalized_lines(F.col("text"))).alias("line"))
        .select("key", "host", "id", "th", F.xxhash64("line").alias("lh"), F.size(F.split("line", " ")).alias("w"))
        .groupBy("key", "host", "id", "th", "lh")
        .agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    )
    # Documents of a line: equal texts count once. Two steps, so that a hot line is summed before it moves.
    per_line = (
        lines.groupBy("host", "lh", "th").agg(F.min("id").alias("first_id"))
        .groupBy("host", "lh").agg(F.count("*").alias("n_docs"), F.min("first_id").alias("first_id"))
    )
    per_host = keyed.groupBy("host", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("host_docs"))
    share = max_share * F.col("host_docs")
    limit = F.greatest(F.lit(float(min_docs)), share if max_docs is None else F.least(share, F.lit(float(max_docs))))
    common = per_line.filter(F.col("n_docs") > min_docs).join(per_host, "host").filter(F.col("n_docs") > limit)
    removed = (
        lines.join(common.select("host", "lh", "first_id"), ["host", "lh"])
        .filter(F.col("id") != F.col("first_id"))
        .groupBy("key").agg(F.sum("w").alias("removed_words"), F.sum("c").alias("n_removed_lines"), *[F.collect_set("lh").alias("common_lines")] * with_lines)
    )
    # Equal rows have one key: what was summed over all of them holds for each.
    each_of = lambda c: F.coalesce(F.expr(f"{c} div copies"), F.lit(0)).cast("long")
    left = F.col("n_words") - each_of("removed_words")
    depleted = (F.coalesce("removed_words", F.lit(0)) > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    out = (
        base.join(removed, "key", "left")
        .withColumn("n_removed_lines", each_of("n_removed_lines"))
        .withColumn("n_left_words", left.cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )
    each = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return out.select("*", each).drop("removed_words", "copies", "copy")
