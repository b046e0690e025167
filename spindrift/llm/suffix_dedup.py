"""Operator 12: removal of repeated byte strings by external induced sorting of suffixes.

A byte goes if a string of ``size`` bytes covers it that also starts anywhere else. The suffixes of all texts
are never sorted whole. Sampled ones are sorted, and the order of the others is induced from them:

1. *Samples.* In each window of ``size`` bytes the ``ANCHOR``-byte piece with the least hash is the window's
   anchor (the leftmost of equals). Equal windows have equal anchors in equal places, wherever they stand, so
   windows need comparing only among those of one anchor. A task makes, for each run of windows with one anchor,
   one tuple: the anchor's hash, the hash of the run's bytes, its place. Runs that repeat one behind the other
   (periodic text) are one tuple with their number. About one tuple in 170 bytes moves; text does not.
2. *Counting.* Tuples are summed by (anchor, bytes). Equal bytes twice: all their windows are repeated, and one
   tuple stands for all in what follows. An anchor with one run alone is done with.
3. *Sorting and inducing.* What is left are anchors that stand in different surroundings. One text of each run
   is read again. Spark's external sort, which spills to disk, is the queue: it hands the suffixes that begin at
   anchors to a task in order. From there suffixes that begin one byte further left are induced, step by step:
   the order of those that follow, taken stably by the byte before them, is their order. Common prefixes travel
   along: two neighbours that come from one byte have one byte more in common than the least of what lay between
   them. A window at the step is repeated if its suffix shares ``size`` bytes with a neighbour. A suffix that can't
   reach so many any more leaves the queue.
4. *Recursion.* An anchor with more than ``GROUP`` different runs (a line that very many documents hold) is not
   gathered: its runs are split in two by their windows' starts, and each half takes, instead of the anchor, all
   bytes that its windows have in common, which are more, and is counted and sorted as before. A single window is
   its own bytes: there counting decides. So no task holds more than ``GROUP`` runs of a key.

Hashes of 64 bits choose candidates; runs count as equal by anchor and bytes, two independent hashes. Null texts
are empty texts. Repeated rows are different documents with the same bytes, so their long texts are removed in each of
them. Texts shorter than ``size`` lose nothing. Very long texts are worked on in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import _BYTE, _tables, buffer_of, byte_slices, mix

ANCHOR = 64
GROUP = 20_000
BLOCK = 1 << 19
#: Rows of runs that a task sorts together.
QUEUE = 20_000
#: Spans and wanted runs (some 30 bytes each) go to all tasks up to so many; more are joined by shuffle.
BROADCAST_ROWS = 20_000
_OTHER = mix(_BYTE + np.uint64(77)) | np.uint64(1)
RUN = "key long, bytes_hash long, doc_id long, th long, start int, n int, off int, times int"


def _sums(block: np.ndarray, table: np.ndarray) -> np.ndarray:
    power, _ = _tables(len(block))
    out = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(table[block] * power[: len(block)], out=out[1:])
    return out


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the bytes from a to b; it does not depend on where they stand."""
    return mix((sums[b] - sums[a]) * _tables(len(sums))[1][a] + (b - a).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` in a row: least of blocks up to and from each place."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor in a batch's texts: doc (index), start (of the first window), n (windows), off
    (of the anchor from start), times, key, bytes_hash."""
    width, parts = size - ANCHOR + 1, []
    shift = np.uint64(max(1, int(BLOCK + size).bit_length()))
    for at in range(0, max(0, len(data) - size + 1), BLOCK):
        block = data[at : at + BLOCK + size - 1]
        n = len(block) - size + 1
        sums = _sums(block, _BYTE)
        place = np.arange(len(block) - ANCHOR + 1)
        hashes = _hash(sums, place, place + ANCHOR)
        anchor = (_least((hashes >> shift << shift) | place.astype(np.uint64), width) & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(at, at + n), "right") - 1
        whole = np.arange(at, at + n) + size <= offsets[doc + 1]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        first, last = first[whole[first]], last[whole[first]]
        if not len(first):
            continue
        key, own = hashes[anchor[first]], _hash(_sums(block, _OTHER), first, last + size)
        again = np.zeros(len(first), bool)
        again[1:] = (key[1:] == key[:-1]) & (own[1:] == own[:-1]) & (first[1:] == last[:-1] + 1) & (doc[first[1:]] == doc[first[:-1]])
        head = np.flatnonzero(~again)
        times = np.diff(np.append(head, len(first)))
        first, last, key, own = first[head], last[head], key[head], own[head]
        parts.append((doc[first], first + at - offsets[doc[first]], last - first + 1, anchor[first] - first, times, key.view(np.int64), own.view(np.int64)))
    names = ("doc", "start", "n", "off", "times", "key", "bytes_hash")
    return {x: np.concatenate(c) if parts else np.zeros(0, np.int64) for x, c in zip(names, zip(*parts) if parts else [()] * 7)}


def _runs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in byte_slices(b.column("text"), 2 << 20):
                data, offsets = buffer_of(b.column("text").slice(lo, hi - lo))
                r = runs_of(data, offsets, size)
                doc = pa.array(r["doc"] + lo)
                short = [pa.array(r[x].astype(np.int32)) for x in ("start", "n", "off", "times")]
                yield pa.RecordBatch.from_arrays([pa.array(r["key"]), pa.array(r["bytes_hash"]), b.column("doc_id").take(doc), b.column("th").take(doc), *short], [f.split()[0] for f in RUN.split(", ")])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted runs, left of the anchor turned round."""
    for b in batches:
        texts = b.column("text")
        for i, wanted in enumerate(b.column("wanted").to_pylist()):
            raw = texts[i].as_py().encode()
            rows = [(w["key"], w["bytes_hash"], w["times"], w["n"], w["off"], raw[w["start"] : w["start"] + w["off"]][::-1], raw[w["start"] + w["off"] : w["start"] + w["n"] - 1 + w["size"]]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["key", "bytes_hash", "times", "n", "off", "left", "right"])


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return np.frombuffer(b"".join(r.ljust(width, b"\0")[:width] for r in rows), np.uint8).reshape(len(rows), width), np.minimum(size, width)


def induce(keys: np.ndarray, left: list[bytes], right: list[bytes], first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, step) of each window that shares ``size`` bytes with another run of its key.

    Runs come sorted by key and ``right`` (what stands from the anchor on). The window of step t begins t bytes left of the
    anchor; a run has the windows of the steps from ``first`` to ``last``.
    """
    low = -(1 << 30)  # at a key's first suffix: nothing is before it
    r, n_right = _matrix(right, max(map(len, right)))
    before, n_left = _matrix(left, max(1, max(map(len, left))))
    same = keys[1:] == keys[:-1]
    apart = r[1:] != r[:-1]
    common = np.minimum(np.where(apart.any(1), apart.argmax(1), r.shape[1]), np.minimum(n_right[1:], n_right[:-1]))
    shared = np.append(low, np.where(same, common, low))  # of each suffix with the one before it in order
    who, group = np.arange(len(keys)), np.cumsum(np.append(True, ~same))
    runs, steps = [], []
    for t in range(int(last.max()) + 1):
        reach = np.maximum(shared, np.append(shared[1:], low))
        hit = (reach >= size) & (first[who] <= t)
        runs.append(who[hit])
        steps.append(np.full(int(hit.sum()), t))
        # On to the next byte to the left: those that have one, and could still come to ``size``.
        kept = np.flatnonzero((last[who] > t) & (n_left[who] > t) & (reach + (last[who] - t) >= size))
        if not len(kept):
            break
        come_from = group[who[kept]] * 256 + before[who[kept], t]
        order = np.argsort(come_from, kind="stable")
        new, come_from = kept[order], come_from[order]
        alike = np.flatnonzero(come_from[1:] == come_from[:-1])
        a, b = new[alike] + 1, new[alike + 1] + 1  # the least of shared[a:b]
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        least, level, width = np.empty(len(a), np.int64), shared, 1
        for j in range(int(k.max()) + 1 if len(k) else 0):
            at = np.flatnonzero(k == j)
            least[at] = np.minimum(level[a[at]], level[b[at] - width])
            level = np.minimum(level[:-width], level[width:]) if len(level) > width else level
            width *= 2
        shared = np.full(len(new), low, np.int64)
        shared[alike + 1] = least + 1
        who = who[new]
    return np.concatenate(runs), np.concatenate(steps)


def _induced(size: int):
    """Windows of runs (from ``a`` to ``b``, counted in the root run) that are repeated; rows come sorted by key and right."""
    names = ("key", "root_key", "root_hash", "shift", "n", "off", "left", "right")

    def work(rows: dict[str, list]) -> pa.RecordBatch:
        keys, off, n, shift, root_key, root_hash = (np.array(rows[x], np.int64) for x in ("key", "off", "n", "shift", "root_key", "root_hash"))
        run, step = induce(keys, rows["left"], rows["right"], off - n + 1, off, size)
        order = np.lexsort((off[run] - step, run))
        run, window = run[order], (off[run] - step)[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(run))[: len(at)] - 1
        who = run[at]
        return pa.RecordBatch.from_arrays([pa.array(root_key[who]), pa.array(root_hash[who]), pa.array((window[at] + shift[who]).astype(np.int32)), pa.array((window[end] + shift[who]).astype(np.int32))], ["key", "bytes_hash", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {x: [] for x in names}
        for b in batches:
            for x in names:
                held[x] += b.column(x).to_pylist()
            if len(held["key"]) > QUEUE:
                cut = held["key"].index(held["key"][-1])  # the last key may go on
                if cut:
                    yield work({x: held[x][:cut] for x in names})
                    held = {x: held[x][cut:] for x in names}
        if held["key"]:
            yield work(held)

    return run


def _halved(size: int):
    """Runs of a hot key in two parts by their windows' distance from the anchor; a part's key is made of all the bytes that windows of its distances have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw, off = r["left"][::-1] + r["right"], r["off"]
                middle = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                    p, q = max(lo, off - r["n"] + 1), min(hi, off)
                    if p <= q:
                        core, own = raw[off - lo : off - hi + size], raw[off - q : off - p + size]
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=b"%d:%d:%d" % (lo, hi, r["key"])).digest(), "little", signed=True)
                        of_bytes = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                        out.append({**r, "key": key, "bytes_hash": of_bytes, "shift": r["shift"] + off - q, "n": q - p + 1, "off": q, "lo": lo, "hi": hi, "left": own[:q][::-1], "right": own[q:]})
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return run


LEVEL = "key long, bytes_hash long, root_key long, root_hash long, shift int, times long, n int, off int, lo int, hi int, left binary, right binary"


def _repeated(runs: DataFrame, size: int, group: int) -> DataFrame:
    """key, bytes_hash, a, b: windows of the runs (key, bytes_hash, times, n, off, left, right) that another run has, too."""
    level = runs.select("key", "bytes_hash", F.col("key").alias("root_key"), F.col("bytes_hash").alias("root_hash"), F.lit(0).alias("shift"), "times", "n", "off", F.lit(0).alias("lo"), F.lit(size - ANCHOR).alias("hi"), "left", "right")
    found = None
    while True:
        hot = materialize(level.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > group).select("key"), "hot")
        any_hot = not hot.isEmpty()
        cold = level.join(hot, "key", "left_anti") if any_hot else level
        queue = cold.select("key", "root_key", "root_hash", "shift", "n", "off", "left", "right").repartition("key").sortWithinPartitions("key", "right")
        part = queue.mapInArrow(_induced(size), "key long, bytes_hash long, a int, b int")
        found = part if found is None else found.unionByName(part)
        if not any_hot:
            return found
        parts = materialize(level.join(hot, "key", "left_semi").select(*[f.split()[0] for f in LEVEL.split(", ")]).mapInArrow(_halved(size), LEVEL), "halves")
        sums = materialize(parts.groupBy("key", "bytes_hash").agg(F.sum("times").alias("sum")), "half-sums")
        twice = parts.join(sums.filter("sum > 1").drop("sum"), ["key", "bytes_hash"]).select(F.col("root_key").alias("key"), F.col("root_hash").alias("bytes_hash"), F.col("shift").alias("a"), (F.col("shift") + F.col("n") - 1).alias("b"))
        found = materialize(found.unionByName(twice), "found")
        # One run stands for all of equal bytes; all of those are repeated already.
        once = parts.groupBy("key", "bytes_hash").agg(F.min(F.struct("root_key", "root_hash", "shift", "n", "off", "lo", "hi", "left", "right")).alias("r")).select("key", "bytes_hash", "r.*").join(sums, ["key", "bytes_hash"]).withColumnRenamed("sum", "times")
        shared = once.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
        level = materialize(once.join(shared, "key", "left_semi"), "level")


def _per_document(docs: DataFrame, rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``docs`` with an array of their own rows' values, null where they have none."""
    lists = materialize(rows.groupBy("doc_id", "th").agg(F.collect_list(value).alias(name)), name)
    small = (lists.agg(F.sum(F.size(name))).first()[0] or 0) <= BROADCAST_ROWS
    same = F.col("d.th").eqNullSafe(F.col("x.th")) & F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
    return docs.alias("d").join((F.broadcast(lists) if small else lists).alias("x"), same, "left").select("d.*", f"x.{name}")


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text"), b.column("spans")):
                raw = text.as_py().encode()
                merged: list[list[int]] = []
                for a, z in sorted((x["a"], x["b"]) for x in spans.as_py() or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                cuts = [0, *[x for s in merged for x in s], len(raw)]
                left = b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                rows.append((len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left if with_text else None, merged))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), KEPT_TYPES)] if rows else [pa.array([], t) for t in KEPT_TYPES]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    return run


KEPT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))


def remove_repeats(docs: DataFrame, size: int = 400, group: int = GROUP, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed ([start, end) in bytes) and, ``with_text``, the kept bytes.

    ``size`` must exceed ``ANCHOR``.
    """
    if size <= ANCHOR:
        raise ValueError(f"size must be more than {ANCHOR}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = materialize(rows.filter(F.octet_length("text") >= size).mapInArrow(_runs(size), RUN.replace("doc_id long", f"doc_id {id_type}")), "runs")
    sums = materialize(runs.groupBy("key", "bytes_hash").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "th", "start", "n", "off")).alias("r")), "run-sums")
    full = sums.filter("times > 1").select("key", "bytes_hash", F.lit(0).alias("a"), (F.col("r.n") - 1).alias("b"))
    contested = materialize(sums.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "contested")
    wanted = sums.join(contested, "key").select("key", "bytes_hash", "times", "r.*")
    listed = _per_document(rows, wanted, "wanted", F.struct("key", "bytes_hash", "times", "start", "n", "off", F.lit(size).alias("size")))
    texts = materialize(listed.filter("wanted is not null").select("text", "wanted").mapInArrow(_cut, "key long, bytes_hash long, times long, n int, off int, left binary, right binary"), "run-texts")
    repeated = materialize(full.unionByName(_repeated(texts, size, group)), "repeated")
    spans = runs.join(repeated, ["key", "bytes_hash"])
    # A tuple of several equal runs is repeated as a whole.
    spans = spans.select("doc_id", "th", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + size + F.when(F.col("times") > 1, (F.col("times") - 1) * F.col("n")).otherwise(0)).alias("b")).alias("span"))
    out = _per_document(rows, spans, "spans", F.col("span"))
    out = out.select("doc_id", "text", "spans").mapInArrow(_kept(with_text), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<array<long>>")
    return out if with_text else out.drop("kept")
