"""What the review of round 3 found."""

import math
import random

from pyspark.sql import functions as F

from spindrift.operators import core
from spindrift.plans.path_census import path_census
from spindrift.plans.session_queries import agent_rollup
from spindrift.sources import transcript_files as tf


def test_census_sums_beyond_what_a_double_holds_exactly(spark):
    lines = ['{"type":"a","at":9007199254740993,"big":123456789012345678901234567890}', '{"type":"a","at":2}', '{"type":"a","at":0.5}', '{"type":"b","at":9007199254740993}', '{"type":"b","at":1}']
    df = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    got = {(r.record, r.path): r for r in path_census(df).collect()}
    assert got["a", "at"].num_sum == 9007199254740993 + 2 + 0.5 and (got["a", "at"].n_int, got["a", "at"].n_float) == (2, 1)
    assert got["b", "at"].num_sum == float(9007199254740994)
    assert (got["a", "big"].n_int, got["a", "big"].n_float) == (0, 1) and got["a", "big"].num_max == 123456789012345678901234567890.0


def test_share_of_a_session_without_tokens_is_nan(spark):
    rec = spark.createDataFrame([("s", "a0", 1, "Read", False, 0, 0, 0, 0), ("t", "a0", 1, "Read", False, 1, 0, 0, 0), ("t", None, 2, "Read", False, 3, 0, 0, 0)], "session_id string, agent_id string, start_ms long, tool string, is_error boolean, input_tokens long, cache_read long, cache_write long, output_tokens long")
    got = {r.session_id: r.share for r in agent_rollup(rec).collect()}
    assert math.isnan(got["s"]) and got["t"] == 0.25


def test_blank_lines_at_the_end_of_a_file_stay(spark, tmp_path):
    texts = {"one": '{"a":1}\n', "two": '{"a":1}\n\n', "crlf": '{"a":1}\r\n', "none": '{"a":1}', "cut": '{"a":1}\n\n{"b'}
    tf.write_files(spark.createDataFrame([("p", k, "main", v) for k, v in texts.items()], "slug string, session string, agent string, content string"), f"file://{tmp_path}/t")
    got = {r.session: r.bytes for r in tf.inventory(tf.listing(spark, f"file://{tmp_path}/t")).collect()}
    assert got == {k: len(v) + (not v.endswith("\n")) for k, v in texts.items()}
    scanned = {r.session: (r.bytes, r.lines) for r in tf.scan(spark, f"file://{tmp_path}/t", F.col("line").startswith("{")).collect()}
    assert scanned == {k: (got[k], 2 if k == "cut" else 1) for k in texts}


def test_ranks_over_few_keys_gather_no_key(spark):
    random.seed(5)
    odd = [float("inf"), float("-inf"), float("nan"), None, 1e308, -1e308, 0.0]
    rows = [(k, random.choice([random.gauss(0, 10), float(random.randint(0, 3)), random.choice(odd)])) for k in ("a", "b", None) for _ in range(400)] + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p95": 0.95, "p50": 0.5, "p0": 0.0, "p100": 1.0}
    got = sorted(map(repr, core.nearest_ranks(df, ["k"], "v", shares, buckets=8).collect()))
    want = df.groupBy("k").agg(*[core.nearest_rank("v", p).alias(n) for n, p in shares.items()], F.count("*").alias("n"))
    assert got == sorted(map(repr, want.collect()))
    plan = core.nearest_ranks(df, ["k"], "v", shares)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_disc" not in plan


def test_sessions_are_dealt_out_by_their_rows(spark):
    assert core.dealt(spark.range(200_000), ["id"], 200_000, 20_000).rdd.getNumPartitions() == 10
    assert core.dealt(spark.range(5), ["id"], 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
