"""Operator 3: n-gram Jaccard join with prefix, length, positional and suffix filters.

A document is the set of its five-word shingles (64-bit hashes of lower-cased words). Documents with
one and the same set form a class, which the join handles as one (its least id). Shingles are ordered
rare first: a sketch of fixed size counts shingles over all documents, the count's logarithm leads the
shingle's key, the hash follows; any order gives the same pairs, this one keeps frequent shingles out
of the prefixes. Two sets of Jaccard similarity >= t share a shingle among the first
n - ceil(t n) + 1 of each, so only these are dealt out, by shingle. Of shingles that two classes or
more hold, pairs are formed and pass the length filter, the positional filter (the first shingle that
both hold has the whole overlap behind it, in either set) and the suffix filter (a partition of the sets
by hash, about as fine as they are large, bounds the overlap part by part); what is left is verified
once per pair on the whole sets.

Only classes' connection is asked for, so a large group of near copies is not expanded into all of its
pairs. For shingles with ``crowd`` members or more, each of ``star_rounds`` rounds lays the members beside
one of them, the one with the fewest rare shingles that is not yet connected to an earlier one, and takes
the components found so far. For those still apart, classes are drawn together further: two sets of one
size that hold the same shingles but for those that no other of them holds overlap alike with any third
set, so one of them stands for all. Then every pair of members that are still apart is formed and
tested, so no link is lost.

Null and blank texts have an empty set and stay alone. Equal rows give equal rows, one out for each in;
rows that share an id are one document that links by any of its texts; rows with a null id take part in
no link (their component is null). Extra columns are not carried. The number of links is not given: inside
a group that is known to hang together most pairs are never tested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import discard, materialize, release
from .components import components
from .secret_scan import slices

SKETCH, CHUNKS = 1 << 22, 16
LEVELS = 5  # bits of a key that say how frequent the shingle is
SEEN = 200_000
FEW = 16  # pairs a member


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    h, _, _, first = textkernel.words_of(texts)
    windows, at = textkernel.window_hashes(h, first, size)
    for a, b in zip(at[:-1], at[1:]):
        yield np.unique(windows[a:b])


def _digest(hashes: np.ndarray) -> bytes:
    """A 128-bit name for a set of sorted hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def profile(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each part of a partition by their first bits, packed.

    There are about as many parts as hashes (a power of two), so that sets which share little differ in
    many parts. Partitions of different sizes nest.
    """
    bits = max(len(hashes).bit_length() - 1, 0)
    while True:
        places = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        counts = np.bincount(places, minlength=1 << bits)
        if counts.max() < 256:
            return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint8).tobytes())
        bits += 1


def overlap_bound(x: bytes, y: bytes) -> tuple[int, int]:
    """The most that two sets can have in common by their profiles, and the sum of their sizes."""
    one, two = (np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8).astype(np.int64) for p in (x, y))
    if len(one) > len(two):
        one, two = two, one
    return int(np.minimum(one, two.reshape(len(one), -1).sum(1)).sum()), int(one.sum() + two.sum())


def _first_pass(size: int):
    """Digest and size of each document's set; and, as rows of size -1, the task's sketch of shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        names = ["id", "digest", "n", "chunk", "parts"]
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column(1), size))
                if sets:
                    counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.nulls(len(sets), pa.int32()), pa.array([profile(s) for s in sets], pa.binary())], names=names)
        parts = [_packed(p) for p in counts.reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64()), pa.array(parts, pa.binary()), pa.array([-1] * CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.nulls(CHUNKS, pa.binary())], names=names)

    return run


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = _unpacked(raw.as_py())
            sums[k] = sums[k] + part if k in sums else part
    for k, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["chunk", "digest"])


def _levels(parts: DataFrame) -> np.ndarray:
    """Of each place of the sketch, the logarithm of how far its count is above the usual one.

    The sketch's size is fixed. The tasks' parts are added chunk by chunk, in two steps; the first has as
    many sums for a chunk as the root of the number of parts, so that neither step gathers them all.
    """
    add = lambda df: df.mapInArrow(_add, "chunk int, digest binary")
    ways = max(1, math.isqrt(parts.count() // CHUNKS))
    some = add(parts.select("chunk", "digest").repartition(CHUNKS * ways, "chunk", F.pmod(F.xxhash64("digest"), F.lit(ways))))
    counts = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    for r in add(some.repartition(CHUNKS, "chunk")).collect():
        counts[r.chunk] += _unpacked(r.digest)
    counts = counts.ravel()
    usual = float(np.median(counts))
    above = np.maximum(counts - usual - 4 * math.sqrt(usual + 1), 0)
    return np.minimum(np.log2(above + 1), (1 << LEVELS) - 1).astype(np.uint8)


def keys_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys in the global order, sorted: rare shingles first. The low bits of the hash give their place in the sketch."""
    level = levels[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(63 - LEVELS)) | (hashes >> np.uint64(LEVELS + 1)))


def least_overlap(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with another one that is similar enough: ceil(n percent / 100)."""
    return -(-n * percent // 100)


def _prefixes(size: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                keys, ids, sizes, lengths = [], [], [], []
                for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), size)):
                    name = _digest(s)
                    if i is None or not len(s) or name in seen:  # a task sends equal sets once
                        continue
                    if len(seen) < SEEN:
                        seen.add(name)
                    keys.append(keys_of(s, levels)[: len(s) - least_overlap(len(s), percent) + 1])
                    ids.append(i)
                    sizes.append(len(s))
                    lengths.append(len(keys[-1]))
                if keys:
                    pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                    columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), pos]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "n", "pos"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key more than one row holds. The last row waits for the next batch."""
    names, held, known = ["key", "id", "n", "pos"], None, False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        if not len(columns[0]):
            continue
        equal = columns[0][1:] == columns[0][:-1]
        together = np.zeros(len(columns[0]), bool)
        together[1:] |= equal
        together[:-1] |= equal
        together[0] |= known and held is not None
        held, known = [c[-1:] for c in columns], bool(together[-1])
        out = np.flatnonzero(together[:-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], names=names)
    if held is not None and known:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column(1), size))
                if sets:
                    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "hashes"])

    return run


def _suffix_filter(percent: int):
    """Keep pairs whose sets can overlap enough, part by part of the fixed partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                most, total = overlap_bound(x, y)
                keep.append((100 + percent) * most >= percent * total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

    return run


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Overlap o with 100 o >= percent (na + nb - o), as 0 <= a condition on (100 + percent) o."""
    return percent * (na + nb)


def _may_link(percent: int) -> Column:
    """Length and positional filters for rows x and y of one key, as if it were the first that both hold."""
    na, nb = F.col("x.n").cast("long"), F.col("y.n").cast("long")
    bound = F.least(na - F.col("x.pos"), nb - F.col("y.pos"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bound >= _needed(na, nb, percent))


def _pair() -> list[Column]:
    return [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the overlap of the whole sets."""
    one = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    na, nb = F.size("a_hashes").cast("long"), F.size("b_hashes").cast("long")
    overlap = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return both.filter((100 + percent) * overlap >= _needed(na, nb, percent)).select("a", "b")


class Search:
    """What the rounds of one search share: the documents, their profiles, and the links found so far."""

    def __init__(self, rows: DataFrame, profiles: DataFrame, size: int, percent: int, broadcast_rows: int):
        self.rows, self.profiles, self.size, self.percent, self.broadcast_rows = rows, profiles, size, percent, broadcast_rows
        self.tested = self.labels = self.waiting = None

    def with_components(self, index: DataFrame) -> DataFrame:
        """Rows of the index with the component that their document is known to belong to."""
        if self.labels is None:
            return index.withColumn("comp", F.col("id"))
        return index.join(self.labels, F.col("id") == F.col("node"), "left").select(*index.columns, F.coalesce("component", "id").alias("comp"))

    def later(self, links: DataFrame) -> None:
        """Links (a, b) for the next time that components are made."""
        self.waiting = links if self.waiting is None else self.waiting.union(links)

    def add(self, links: DataFrame | None = None) -> None:
        """Take links (a, b) into the components. What is known already is a star per component."""
        if links is not None:
            self.later(links)
        links, self.waiting = self.waiting, None
        if links is None:
            return
        known = None if self.labels is None else self.labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        self.labels = materialize(components(links if known is None else links.union(known)), "labels")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """The whole sets of some documents; their ids are counted before they are sent about."""
        few = ids.count() <= self.broadcast_rows
        texts = self.rows.join(F.broadcast(ids) if few else ids, "id")
        return materialize(texts.select("id", "text").mapInArrow(_whole_sets(self.size), "id long, hashes array<long>"), "whole-sets")

    def test(self, found: DataFrame) -> DataFrame | None:
        """The pairs (a, b) among joined rows x and y of one key that link; None if there is none to test."""
        pairs = found.filter(_may_link(self.percent)).select(*_pair()).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        one = lambda c: self.profiles.select(F.col("id").alias(c), F.col("parts").alias(f"{c}_parts"))
        near = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "a_parts", "b_parts")
        pairs = materialize(near.mapInArrow(_suffix_filter(self.percent), "a long, b long").distinct(), "pairs")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        if pairs.isEmpty():
            return None
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        links = materialize(verify(pairs, sets, self.percent), "links-found")
        discard(sets)
        return None if links.isEmpty() else links


def _lead(now: DataFrame, turn: int) -> DataFrame:
    """Of each key whose members are still apart, the one that the others are laid beside.

    First the one with the least share of rarer shingles, which most near copies of a text are nearest to;
    then the best that is not connected to it, then any such.
    """
    order = lambda k: F.struct((F.col("pos") / F.col("n")).alias("o"), F.xxhash64("id").alias("h")) if k < 2 else F.struct(F.xxhash64("id", F.lit(k)).alias("h"))
    best = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", order(0)).alias("first")).filter("lo <> hi")
    rest = now if not turn else now.join(best.select("key", "first"), "key").filter("comp <> first")
    lead = rest.groupBy("key").agg(F.min_by(F.struct("id", "n", "pos", "comp"), order(turn)).alias("y"))
    return lead.join(best.select("key"), "key", "left_semi").select("key", "y.*")


def _alike(alive: DataFrame, search: Search) -> DataFrame:
    """(id, rep, held): of each document of ``alive`` the least one that overlaps with all others of them as it does.

    Shingles that no second one of them holds add nothing to an overlap; sets of one size with the same
    other shingles, ``held`` in number, are alike.
    """
    ids = materialize(alive.select("id").distinct(), "alive")
    sets = search.sets_of(ids)
    each = sets.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    held = each.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("h")
    several = sets.groupBy("id").count().filter("count > 1").select("id")  # documents of more than one text stand for themselves
    core = each.join(several, "id", "left_anti").join(held, "h").groupBy("id", "n").agg(F.count("*").alias("held"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("s2"))
    least = core.groupBy("n", "held", "s1", "s2").agg(F.min("id").alias("rep"))
    alone = several.select("id", F.col("id").alias("rep"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("held"))
    out = materialize(core.join(least, ["n", "held", "s1", "s2"]).select("id", "rep", "n", "held").union(alone), "alike")
    discard(sets)
    return out


def _hopeful(index: DataFrame, percent: int) -> DataFrame:
    """Rows of an index for which their key holds another row that the length and positional filters may pass.

    A row's rest (what follows the shingle, and it) bounds the size of a partner, and the partner's rest that
    of the row. Sizes are binned, a tenth apart; of each key and bin the largest bound is enough to know.
    """
    n = F.col("n").cast("long")
    bin_of = lambda x: F.floor(F.log(x.cast("double")) / math.log(1.1)).cast("int")
    rows = index.withColumn("most", F.floor((100 + percent) * (n - F.col("pos")) / percent).cast("long") - n)
    of_bin = rows.groupBy("key", bin_of(n).alias("bin")).agg(F.max(F.struct("most", "id")).alias("top"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    low, high = F.ceil(n * percent / 100), F.least(F.col("most"), F.floor(n * 100 / percent))
    asked = rows.filter(high >= low).withColumn("bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    ok = (F.col("top.most") >= n) & ((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id")))
    return asked.join(of_bin, ["key", "bin"]).filter(ok).select(*index.columns).distinct()


def _of_size(index: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Rows of keys that so many rows hold, two documents among them."""
    counts = index.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi")
    return index.join(counts.filter(F.col("m") >= least if most is None else F.col("m").between(least, most)).select("key"), "key", "left_semi")


def _crowded(search: Search, crowded: DataFrame, star_rounds: int) -> None:
    """All links that connect anything, among members of one key with many."""
    percent = search.percent
    for turn in range(star_rounds):
        now = materialize(search.with_components(crowded), "members")
        found = now.alias("x").join(_lead(now, turn).alias("y"), "key").filter(F.expr("x.comp <> y.comp"))
        links = search.test(found)
        discard(now)
        if links is not None:
            search.add(links)
    now = materialize(search.with_components(crowded), "members")
    parts = now.groupBy("key", "comp").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
    apart = parts.filter("m * m > same").select("key", (F.expr("m * m - same") > 2 * FEW * F.col("m")).alias("wide"))
    alive = materialize(now.join(apart, "key"), "alive-members")
    discard(now)
    if alive.isEmpty():
        return
    # Where few pairs a member are still apart, these are tested.
    near = alive.filter("not wide")
    links = search.test(near.alias("x").join(near.alias("y"), "key").filter(F.expr("x.comp <> y.comp and x.id < y.id")))
    if links is not None:
        search.later(links)
    alive = alive.filter("wide").drop("wide", "comp")
    if alive.isEmpty():
        return
    alike = _alike(alive, search)
    together = F.expr(f"{100 + percent} * held >= {2 * percent} * n")
    mates = alike.filter("id <> rep")
    # Those alike without linking each other may stand in several components: their one is tested with all.
    several = alike.filter(~together).groupBy("rep").agg(F.count("*").alias("m")).filter("m > 1").select("rep", F.lit(True).alias("lone"))
    only = search.with_components(alive.join(alike.filter("id = rep").select("id"), "id", "left_semi"))
    only = materialize(only.join(several, F.col("id") == F.col("rep"), "left").drop("rep"), "alike-members")
    links = search.test(only.alias("x").join(only.alias("y"), "key").filter(F.expr("x.id < y.id and (x.comp <> y.comp or x.lone or y.lone)")))
    new = mates.filter(together).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    if links is not None:
        also = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        new = new.union(links).union(mates.join(also, "rep").select(F.col("id").alias("a"), F.col("other").alias("b")))
    search.later(new)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, star_rounds: int = 2, crowd: int = 32, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links).

    ``broadcast_rows``: up to so many ids of documents to verify are sent to all tasks, more are joined by
    shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = materialize(rows.mapInArrow(_first_pass(size), "id long, digest binary, n long, chunk int, parts binary"), "shingle-sets")
    levels = _levels(first.filter("n = -1"))
    members = first.filter("n >= 0")
    # Equal sets: the least id stands for the class.
    least = members.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    others = members.filter("n > 0").join(least, "digest").filter("id <> rep").select("id", "rep").distinct()
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    prefixes = rows.mapInArrow(_prefixes(size, percent, levels), "key long, id long, n int, pos int")
    shared = prefixes.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_shared, "key long, id long, n int, pos int")
    mapped = shared.join(others, "id", "left").select("key", F.coalesce("rep", "id").alias("id"), "n", "pos").distinct()
    index = materialize(mapped, "prefix-index")
    crowded = materialize(_of_size(_hopeful(_of_size(index, crowd), percent), 2), "crowded-keys")
    sparse = materialize(_of_size(index, 2, crowd - 1), "other-keys")
    discard(index)
    search = Search(rows, members.filter("n > 0 and id is not null").select("id", "parts"), size, percent, broadcast_rows)
    if not crowded.isEmpty():
        _crowded(search, crowded, star_rounds)
    discard(crowded)
    now = search.with_components(sparse)
    links = search.test(now.alias("x").join(now.alias("y"), "key").filter(F.expr("x.comp <> y.comp and x.id < y.id")))
    search.add(links)
    discard(sparse)
    reps = members.filter("id is not null").join(others, "id", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).alias("node"))
    label = search.labels if search.labels is not None else docs.sparkSession.createDataFrame([], "node long, component long")
    joined = reps.join(label, "node", "left")
    alone = members.filter("id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id")).union(alone)
