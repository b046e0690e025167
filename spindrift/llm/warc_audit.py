"""Operator 7: Merkle fixity audit of WARC replicas.

Pages become WARC response records, records stand one after the other in files of a fixed range of
record numbers, so that each has an offset range. A record's leaf is the hash of its bytes, its number
and its range; a tree node is the hash of its children in order and of the range that they cover, with
``fanout`` children at most. The trees of two replicas are compared from the root; only children of
nodes that differ are looked at, down to the records that are corrupt, missing or extra.

A tree level is one grouped sum over the level below: no task sees more than ``fanout`` children per
node, and the top has one row. Files come from number ranges: no file is gathered whole; the running
offset is a window over the records of one file.

Null urls and bodies are written as empty strings; a null id becomes a number below zero, from a hash of url and body. Rows with one
number are records of one leaf, ordered by their hash. Extra columns are not carried. An empty replica
has no root; against it every record of the other one is missing or extra.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: the end of a WARC record.
END = "\r\n\r\n"


def warc_record(number: Column, url: Column, body: Column) -> Column:
    """The text of a response record with its payload."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), number.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit(END),
    )


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = 1024) -> DataFrame:
    """number, file, url, length, digest (SHA-256 of the record's bytes), offset of each record in its file."""
    # Rows without an id get a number below zero by their content, so that they do not all meet in one file.
    unnamed = -1 - F.pmod(F.xxhash64(F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))), F.lit(1 << 31))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("number"), F.col(url_col).alias("url"), F.col(html_col).alias("body"))
    record = rows.withColumn("record", warc_record(F.col("number"), F.col("url"), F.col("body")))
    record = record.select("number", "url", F.floor(F.col("number") / per_file).cast("long").alias("file"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("number", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return record.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def parse_record(record: Column) -> Column:
    """The payload of a record's text, by its Content-Length."""
    head = F.substring_index(record, "\r\n\r\n", 1)
    size = F.regexp_extract(head, r"Content-Length: (\d+)", 1).cast("int")
    return F.decode(F.substring(F.encode(record, "UTF-8"), F.octet_length(head) + 5, size), "UTF-8")


def merkle_levels(records: DataFrame, fanout: int = 16) -> list[DataFrame]:
    """From the leaves up: tables of node, low, high (offset range over all files), hash; the last has one row."""
    leaf = records.groupBy(F.col("number").alias("node")).agg(
        F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "digest", "file", "offset", "length")))), 256).alias("hash"),
        F.min(F.struct("file", "offset")).alias("low"), F.max(F.struct("file", (F.col("offset") + F.col("length")).alias("offset"))).alias("high"), F.count("*").alias("records"),
    )
    levels = [materialize(leaf, "merkle-0")]
    low, high = levels[0].agg(F.min("node"), F.max("node")).first()
    if low is None:
        return levels
    depth = max(1, math.ceil(math.log(max(abs(low), abs(high)) + 1, fanout) + 1e-9))
    for k in range(1, depth + 1 + (low < 0)):
        below = levels[-1]
        parts = F.array_sort(F.collect_list(F.struct("node", "hash", "low", "high")))
        up = below.groupBy(F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(
            F.sha2(F.to_json(parts), 256).alias("hash"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("records").alias("records")
        )
        levels.append(materialize(up, f"merkle-{k}"))
    return levels


def audit(left: DataFrame, right: DataFrame, fanout: int = 16) -> DataFrame:
    """Records that differ: number, file, offset, length, status (corrupt, missing, extra), both digests.

    ``left`` and ``right``: what ``to_records`` gives for either replica.
    """
    a, b = merkle_levels(left, fanout), merkle_levels(right, fanout)
    depth = max(len(a), len(b))
    suspects = None
    for k in range(depth - 1, -1, -1):
        empty = (a or b)[0].limit(0)
        x, y = (t[k] if k < len(t) else empty for t in (a, b))
        if suspects is not None:
            under = lambda t: t.join(F.broadcast(suspects) if small else suspects, F.floor(F.col("node") / fanout) == F.col("parent"), "left_semi")  # noqa: E731, B023
            x, y = under(x), under(y)
        both = x.select("node", F.col("hash").alias("h1")).join(y.select("node", F.col("hash").alias("h2")), "node", "full").filter("h1 is null or h2 is null or h1 <> h2")
        suspects = materialize(both.select(F.col("node").alias("parent")), f"suspects-{k}")
        small = suspects.count() <= 100_000
        if k and k >= min(len(a), len(b)):  # the other tree is lower: everything below is to be compared
            suspects = None
    bad = suspects.withColumnRenamed("parent", "number")
    one = lambda t, n: t.join(F.broadcast(bad) if small else bad, "number", "left_semi").select("number", F.col("file").alias(f"file{n}"), F.col("offset").alias(f"offset{n}"), F.col("length").alias(f"length{n}"), F.col("digest").alias(f"digest{n}"), F.row_number().over(Window.partitionBy("number").orderBy("digest")).alias("k"))
    joined = one(left, 1).join(one(right, 2), ["number", "k"], "full")
    status = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest1").isNull(), "extra").when(F.col("digest1") != F.col("digest2"), "corrupt").otherwise("moved")
    return joined.select("number", F.coalesce("file1", "file2").alias("file"), F.coalesce("offset1", "offset2").alias("offset"), F.coalesce("length1", "length2").alias("length"), status.alias("status"), F.col("digest1").alias("digest"), F.col("digest2").alias("replica_digest"))
