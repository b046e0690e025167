"""A training corpus from raw documents: rules, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir), sees all that the one before it kept, and returns a DataFrame,
which is written as Parquet to the shared folder and read again for the next one. All but the last
return the columns of ``documents``. Rows with null ids or texts, repeated rows and empty tables pass
through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import secret_scan
from spindrift.llm.bpe_codec import encode_decode
from spindrift.llm.common import arrow_batches, materialize, row_key, table
from spindrift.llm.decontaminate import leaks
from spindrift.llm.ngram_join import near_duplicates
from spindrift.llm.quality_rules import quality_rules, without_lines
from spindrift.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys to drop are sent to all tasks up to so many rows; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is not in ``dropped``, which is counted before it is sent about."""
    dropped = materialize(dropped.select(on).distinct(), "dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if small else dropped, on, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are common on their host."""
    verdict = quality_rules(docs, with_lines=True).filter("not kept or common_lines is not null").select("key", "kept", "common_lines")
    changed = materialize(verdict.groupBy("key").agg(F.first("kept").alias("kept"), F.first("common_lines").alias("common_lines")), "verdicts")
    small = changed.count() <= BROADCAST_ROWS
    rows = docs.withColumn("key", row_key("doc_id", "text")).join(F.broadcast(changed) if small else changed, "key", "left").filter("coalesce(kept, true)")
    text = without_lines(F.col("text"), F.col("common_lines"))
    n_chars = F.when(F.col("common_lines").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return rows.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, each of its different texts once."""
    groups = materialize(near_duplicates(docs).select("doc_id", "component_id"), "groups")
    kept = without(docs, groups.filter("doc_id <> component_id"), "doc_id").select(*COLUMNS)
    repeated = materialize(groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    few = repeated.count() <= BROADCAST_ROWS
    rows = kept.join((F.broadcast(repeated) if few else repeated).withColumn("again", F.lit(True)), "doc_id", "left")
    each = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = rows.filter("again").groupBy("doc_id", "text").agg(F.min(F.struct(*each)).alias("r")).select("doc_id", "text", *[f"r.{c}" for c in each])
    return rows.filter("again is null").select(*COLUMNS).union(once.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    name = lambda i, h: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("null")), h)
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(name("doc_id", F.col("text_hash")).alias("name"))
    return without(docs.withColumn("name", name("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))), found, "name").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by a mark."""
    arrow_batches(spark)
    found = secret_scan.scan(docs, secret_scan.fit(docs), carry=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with digests of the ids and of what they decode to."""
    arrow_batches(spark)
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json"), block_mb=8, with_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]

#: The tagger and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
