"""Operator 13: how far sources of one language differ in their words, by an exact recount over perfect hashes.

First pass: every document's distinct terms, summed by (lang, term) in the task and then over all tasks; terms
in at least ``min_docs`` documents of a language are its vocabulary, exactly. The vocabulary is dealt into shards
of about ``shard_terms`` terms, and each shard gets a minimal perfect hash: levels of bit arrays, in which a key
takes the place of its hash at the first level where no other key claims it; a place's number is the number of
set bits before it. The few keys that share their whole hash are listed behind. A shard stores its terms in the
order of places, so that a place found for a term is verified against the stored term.

Second pass: shards go to all tasks, at most ``pass_terms`` terms at a time, so that a vocabulary of any size
takes more passes, never more memory. A task counts in dense arrays, a slot per vocabulary term for each (lang,
source) it meets, and gives what it has whenever the arrays take more than ``DENSE_BYTES``. Counts are summed by
slot and laid beside their shard's terms, where all arithmetic is done in whole numbers on (source x slot) blocks.

Null text, lang and source count as ''. Groups without terms are there with counts of 0 (p alike for all terms). A
language without vocabulary has value 0 in part ``pair`` and no rows in part ``term``. Repeated rows are documents
of their own. An empty table gives no rows. The pair part has a row for each two sources of a language, as asked
for; the sources of one language stand together in one row on the way there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .textkernel import LETTERS, byte_slices, mix, terms_of, word_hashes

SLICE_BYTES = 4 << 20
DENSE_BYTES = 64 << 20
#: Cells of one block of sources and slots.
BLOCK_CELLS = 4_000_000
LEVELS = 24


# ---- minimal perfect hashing


def _key_hashes(keys: pa.Array) -> np.ndarray:
    """A 64-bit hash per key."""
    keys = keys.cast(pa.large_binary())
    at = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2], np.uint8) if keys.buffers()[2] is not None else np.zeros(0, np.uint8)
    return word_hashes(data, at[:-1], at[1:], lower=False)


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Places 0 to n - 1 for n different keys, which are stored in the order of their places."""

    def __init__(self, keys: pa.Array, levels: list[tuple[int, bytes]]):
        """``levels``: the size and the packed bits of each."""
        self.keys, self.bits, self.before, count = keys, [], [], 0
        for size, packed in levels:
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
            self.bits.append(bits)
            self.before.append(count + np.cumsum(bits) - bits)
            count += int(bits.sum())
        self.listed = (count, keys.slice(count))  # keys of equal hashes

    @staticmethod
    def build(keys: pa.Array) -> tuple[pa.Array, list[tuple[int, bytes]]]:
        """The keys in the order of their places, and the levels."""
        keys, levels, ordered = keys.cast(pa.large_binary()), [], []
        left, hashes = np.arange(len(keys)), _key_hashes(keys) if len(keys) else np.zeros(0, np.uint64)
        while len(left) and len(levels) < LEVELS:
            size = 2 * len(left) + 1
            at = _level(hashes[left], len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            own = bits[at]
            ordered.append(left[own][np.argsort(at[own])])
            levels.append((size, np.packbits(bits).tobytes()))
            left = left[~own]
        return keys.take(pa.array(np.concatenate([*ordered, left]).astype(np.int64))), levels

    def places(self, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for keys that are not stored."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before)):
            if not len(left):
                break
            at = _level(hashes[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        if len(self.listed[1]) and len(left):
            more = pc.fill_null(pc.index_in(keys.take(pa.array(left)), value_set=self.listed[1]), -1).to_numpy(zero_copy_only=False)
            out[left[more >= 0]] = self.listed[0] + more[more >= 0]
        some = np.flatnonzero(out >= 0)
        same = pc.equal(keys.take(pa.array(some)), self.keys.take(pa.array(out[some]))).to_numpy(zero_copy_only=False)
        out[some[~same]] = -1
        return out


# ---- first pass


def _groups(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of a text column, null as '', and what they stand for."""
    d = pc.fill_null(values.cast(pa.large_string()), "").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _distinct_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The slice's distinct terms, and for each occurrence its term and its row."""
    terms, first = terms_of(texts, LETTERS)
    d = terms.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(first))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, h (hash of the term), n: documents of the slice that hold the term."""
    for b in batches:
        for lo, hi in byte_slices(b.column("text"), SLICE_BYTES):
            lang, langs = _groups(b.column("lang").slice(lo, hi - lo))
            words, code, row = _distinct_terms(b.column("text").slice(lo, hi - lo))
            if not len(words):
                continue
            once = np.unique(row * len(words) + code)
            keys, n = np.unique(lang[once // len(words)] * len(words) + once % len(words), return_counts=True)
            w = keys % len(words)
            h = _key_hashes(words)[w].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(keys // len(words))).cast(pa.string()), words.take(pa.array(w)).cast(pa.binary()), pa.array(h), pa.array(n.astype(np.int64))], ["lang", "term", "h", "n"])
    release()


def vocabulary(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, term, h: the terms in at least ``min_docs`` documents of their language."""
    counts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, h long, n long")
    return counts.groupBy("lang", "term", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term", "h")


# ---- second pass


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with their terms in the order of places, and the levels of their hash."""
    for b in batches:
        made = [PerfectHash.build(pa.array(t, pa.large_binary())) for t in b.column("terms").to_pylist()]
        terms, levels = pa.array([k.to_pylist() for k, _ in made], pa.list_(pa.binary())), pa.array([[{"size": n, "bits": x} for n, x in v] for _, v in made], pa.list_(pa.struct([("size", pa.int32()), ("bits", pa.binary())])))
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("shard"), b.column("n_shards"), terms, levels], ["lang", "shard", "n_shards", "terms", "levels"])


def _places_of(words: pa.Array, hashes: np.ndarray, shards: dict[int, PerfectHash], n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and place of each word, place -1 where it is in none of the shards at hand."""
    shard = np.mod(hashes.view(np.int64), n_shards)
    place = np.full(len(words), -1, np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        table = shards.get(int(shard[part[0]]))
        if table is not None:
            place[part] = table.places(words.take(pa.array(part)), hashes[part])
    return shard, place


def _recount(tables):
    """lang, source, shard, slot, n, of what the slices hold; dense counts in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        if "built" not in held:  # once a worker
            held["built"] = {k: PerfectHash(pa.array(terms, pa.large_binary()), levels) for k, (terms, levels) in held.pop("shards").items()}
        built, sizes = held["built"], held["sizes"]
        of = {lang: {s: p for (x, s), p in built.items() if x == lang} for lang in sizes}
        base = {lang: dict(zip(sorted(of[lang]), np.concatenate([[0], np.cumsum([len(of[lang][s].keys) for s in sorted(of[lang])])]).tolist())) for lang in sizes}
        width = {lang: sum(len(p.keys) for p in of[lang].values()) for lang in sizes}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                at = np.flatnonzero(counts)
                starts = np.array([base[lang][s] for s in sorted(of[lang])], np.int64)
                k = np.searchsorted(starts, at, "right") - 1
                shard = np.array(sorted(of[lang]), np.int64)[k]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(shard.astype(np.int32)), pa.array((at - starts[k]).astype(np.int32)), pa.array(counts[at])], ["lang", "source", "shard", "slot", "n"])
            dense.clear()

        for b in batches:
            for lo, hi in byte_slices(b.column("text"), SLICE_BYTES):
                lang, langs = _groups(b.column("lang").slice(lo, hi - lo))
                source, sources = _groups(b.column("source").slice(lo, hi - lo))
                words, code, row = _distinct_terms(b.column("text").slice(lo, hi - lo))
                if not len(words):
                    continue
                hashes = _key_hashes(words)
                group = lang * len(sources) + source
                for x, name in enumerate(langs):
                    if not width.get(name):
                        continue
                    shard, place = _places_of(words, hashes, of[name], sizes[name])
                    known = place >= 0
                    slot = np.where(known, place, 0)
                    slot[known] += np.array([base[name][s] for s in shard[known].tolist()], np.int64)
                    here = np.flatnonzero((lang[row] == x) & known[code])
                    if not len(here):
                        continue
                    cells, n = np.unique(group[row[here]] * len(words) + code[here], return_counts=True)
                    cuts = np.flatnonzero(np.diff(cells // len(words))) + 1
                    for part, m in zip(np.split(cells, cuts), np.split(n, cuts)):
                        key = (name, sources[int(part[0] // len(words)) % len(sources)])
                        if key not in dense:
                            if sum(a.nbytes for a in dense.values()) + 8 * width[name] > DENSE_BYTES:
                                yield from given()
                            dense[key] = np.zeros(width[name], np.int64)
                        dense[key][slot[part % len(words)]] += m
        yield from given()
        release()

    return run


# ---- arithmetic


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) by long division, so that nothing leaves 64 bits; total > count."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    out += rest // total
    rest = rest % total
    for _ in range(9):
        rest = rest * 10
        out = out * 10 + rest // total
        rest = rest % total
    return out + 1


def _compare(counts: pa.Table, shard: pa.Table, most: int) -> pa.Table:
    """One shard of a language: its part of each pair's value, and its ``most`` best terms of each source."""
    lang, sources, totals, all_n, v, terms = (shard.column(c)[0].as_py() for c in ("lang", "sources", "totals", "lang_total", "v", "terms"))
    grid = np.zeros((len(sources), len(terms)), np.int64)
    row = pc.index_in(counts.column("source").combine_chunks(), value_set=pa.array(sources, pa.string())).to_numpy(zero_copy_only=False)
    grid[row, counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    p = _share(grid, np.array(totals, np.int64)[:, None] + v)
    all_p = _share(grid.sum(0), np.int64(all_n + v) * np.ones(1, np.int64))
    out_source, out_item, out_q, value, part = [], [], [], [], []
    names = np.array(sources, object)
    step = max(1, BLOCK_CELLS // max(1, p.size))
    for a in range(0, len(sources), step):
        diff = p[a : a + step, None, :] - p[None, :, :]
        sums = (diff * diff // p[None, :, :]).sum(2)
        i, j = np.nonzero(np.arange(a, a + len(sums))[:, None] != np.arange(len(sources))[None, :])
        out_source += names[a + i].tolist()
        out_item += names[j].tolist()
        value += sums[i, j].tolist()
        part += ["pair"] * len(i)
    i, j = np.nonzero((grid > 0) & (p > all_p[None, :]))
    diff = p[i, j] - all_p[j]
    worth = diff * diff // all_p[j]
    in_order = np.empty(len(terms), np.int64)
    in_order[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    best = np.lexsort((in_order[j], -worth, i))
    best = best[np.arange(len(best)) - np.searchsorted(i[best], i[best]) < most]
    i, j, worth = i[best], j[best], worth[best]
    out_source += names[i].tolist()
    out_item += [terms[x].decode() for x in j.tolist()]
    value += worth.tolist()
    part += ["term"] * len(i)
    n = len(part)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(out_source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(out_item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, min_docs: int = 3, most: int = 200, shard_terms: int = 4096, pass_terms: int = 4_000_000) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = materialize(docs.select("lang", "source").distinct(), "groups")
    words = materialize(vocabulary(docs, min_docs), "vocabulary")
    sizes = words.groupBy("lang").agg(F.count("*").alias("v"))
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("s")).join(sizes, "lang", "left").na.fill(0, ["v"])
    # Fewer terms a shard where a language has many sources: a block of sources x slots stays bounded.
    own = F.greatest(F.lit(64), F.least(F.lit(shard_terms), F.floor(F.lit(BLOCK_CELLS) / F.col("s"))))
    per_lang = materialize(per_lang.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("v") / own)).cast("long")), "languages")
    dealt = words.join(F.broadcast(per_lang.select("lang", "n_shards")), "lang").withColumn("shard", F.pmod("h", "n_shards").cast("int"))
    # A shard's terms are few by construction, so that they may stand in one row.
    shards = dealt.groupBy("lang", "shard", "n_shards").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    shards = materialize(shards.mapInArrow(_build, "lang string, shard int, n_shards long, terms array<binary>, levels array<struct<size: int, bits: binary>>"), "shards")
    total = words.count()
    n_passes = max(1, -(-total // pass_terms))
    number = F.pmod(F.xxhash64("lang", "shard"), F.lit(n_passes))
    counts = None
    for k in range(n_passes):
        mine = shards.filter(number == k).collect()  # about ``pass_terms`` terms
        if not mine:
            continue
        tables = {"shards": {(r.lang, r.shard): ([bytes(t) for t in r.terms], [(x.size, bytes(x.bits)) for x in r.levels]) for r in mine}, "sizes": {r.lang: r.n_shards for r in mine}}
        tables = spark.sparkContext.broadcast(tables)
        found = docs.mapInArrow(_recount(tables), "lang string, source string, shard int, slot int, n long")
        found = materialize(found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")), "recount")
        counts = found if counts is None else counts.unionByName(found)
    schema = "lang string, source string, part string, item string, value long"
    if counts is None:
        made = spark.createDataFrame([], schema)
    else:
        totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
        packed = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("lang_total")).join(sizes, "lang")
        packed = packed.select("lang", "lang_total", "v", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"))
        blocks = shards.select("lang", "shard", "terms").join(F.broadcast(packed), "lang")
        made = counts.groupBy("lang", "shard").cogroup(blocks.groupBy("lang", "shard")).applyInArrow(lambda a, b: _compare(a, b, most), schema)
        made = materialize(made, "compared")
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    sums = made.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = made.filter("part = 'term'").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)
