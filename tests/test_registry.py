"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import math
import os
import re

import duckdb
import pandas as pd
import pytest

from spindrift.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def canon(frame):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        try:
            return round(float(v), 6)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        assert canon(got) == canon(con.sql(ORACLE[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_streamed_alerts_equal_a_plain_loop(spark):
    from spindrift.streaming.alerts import decide

    rows = duckdb.sql(f"SELECT user_id, event_id, epoch_us(ts) // 1000, event_type FROM '{DATA}/events.parquet' ORDER BY event_id").fetchall()
    by_user = {}
    for user, *row in rows:
        by_user.setdefault(user, []).append(tuple(row))
    want = sorted((u, n, level) for u, r in by_user.items() for n, level in decide(None, None, r, 300_000)[2])
    assert sorted(map(tuple, QUERIES["streamed_alerts"](spark, DATA).collect())) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_repeated_ngrams_equal_a_plain_loop(spark):
    from spindrift.sources.records import records

    tools = {}
    for r in records(spark, DATA).filter("tool is not null").orderBy("session_id", "ord").collect():
        tools.setdefault(r.session_id, []).append(r.tool)
    want = set()
    for s, seq in tools.items():
        for gram in {tuple(seq[i : i + 3]) for i in range(len(seq) - 2)}:
            i = n = 0
            while i <= len(seq) - 3:
                hit = tuple(seq[i : i + 3]) == gram
                n, i = n + hit, i + (3 if hit else 1)
            if n >= 2:
                want.add((s, " ".join(gram), n))
    assert set(map(tuple, QUERIES["repeated_ngrams"](spark, DATA).collect())) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_redaction_report_equals_a_plain_loop(spark):
    from spindrift.functions.text import STEPS

    got = {r.kind: (r.masked, r.documents) for r in QUERIES["redaction_report"](spark, DATA).collect()}
    want = {kind: [0, 0] for kind, *_ in STEPS}
    for (text,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' WHERE text IS NOT NULL").fetchall():
        for kind, pattern, mark, _ in STEPS:
            text, n = re.subn(pattern.replace(r"\z", r"\Z"), mark.replace("$1", r"\1"), text, flags=re.ASCII)
            want[kind][0] += n
            want[kind][1] += n > 0
    assert got == {k: tuple(v) for k, v in want.items()}
