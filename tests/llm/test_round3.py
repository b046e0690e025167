"""Search, repeated byte strings and divergence of sources: brute force, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from spindrift.llm import lexical_search, source_divergence, suffix_dedup

from .brute import LOWER
from .test_llm import SCHEMA, sentence


def removed(rows, size):
    """(id, bytes, removed, runs, digest) of each row, by all windows of ``size`` bytes."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + size] for _, r in raws for k in range(len(r) - size + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        left = bytes(c for c, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def byte_corpus(seed):
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (14, 16, 40, 90)]
    texts = []
    for k in range(40):
        parts = [sentence(rng, rng.randint(3, 60))]
        for s in shared:
            if rng.random() < 0.4:
                cut = rng.randint(0, len(s) // 3)
                parts += [s[cut : len(s) - rng.randint(0, len(s) // 3)], sentence(rng, rng.randint(1, 30))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1][:-7] + "x", "é" + texts[2], "=" * 1500, "-=" * 300 + "end", "ab " * 400, "=" * 120, None, "", "short", texts[3] + " tail " + texts[3], "\0" * 700]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[5], (7, "other text under an id"), (None, texts[4]), (None, None)]


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "h", 0, "k", 9, 1, "d", "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size,group", [(100, 4), (400, 20_000)])
def test_op12_equals_all_windows(spark, size, group):
    rows = byte_corpus(size + group)
    got = suffix_dedup.remove_repeats(as_docs(spark, rows), size, group).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == sorted(removed(rows, size), key=repr)
    texts = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.removed) == r.n_removed for r in got) and texts


def test_op12_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    import numpy as np
    import pyarrow as pa

    from spindrift.llm.textkernel import buffer_of

    data, offsets = buffer_of(pa.array([t for _, t in byte_corpus(1)]))
    r = suffix_dedup.runs_of(data, offsets, 150)
    lengths = np.diff(offsets)
    assert (r["n"] * r["times"]).sum() == np.maximum(lengths - 149, 0).sum()  # each window is in one run


def test_op12_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op12_all_windows_of_one_key_are_equal(spark):
    rows = [(i, "x" * (300 + i)) for i in range(20)]
    got = suffix_dedup.remove_repeats(as_docs(spark, rows), 100, 6).collect()
    assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in got)


# ---- search


def terms(text, pattern=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def ranked(docs, items, k=10):
    d = [(i, Counter(terms(t))) for i, t in docs]
    d = [(i, c, sum(c.values())) for i, c in d if c]
    n, total = len(d), sum(x for *_, x in d)
    df = Counter(w for _, c, _ in d for w in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, size in d:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(5)
    docs = [(i, sentence(rng, rng.randint(1, 120))) for i in range(120)]
    docs += [docs[3], (None, docs[4][1]), (None, None), (500, ""), (501, "..!"), (502, "ALPHA1 alpha1 Äpfel äpfel"), (503, docs[9][1].upper()), (504, sentence(rng, 30_000))]
    items = [(k, sentence(rng, rng.randint(1, 20))) for k in range(15)] + [(1, "alpha1 äpfel Äpfel"), (1, "alpha1 äpfel Äpfel"), (77, None), (78, "--"), (79, "neverseen"), (None, "the and of"), (80, sentence(rng, 150)), (81, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("block_terms,slice_bytes", [(1_000_000, 8 << 20), (60, 2000)])
def test_op11_equals_all_scores(spark, monkeypatch, block_terms, slice_bytes):
    docs, items = search_rows()
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", slice_bytes)
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical_search.search(as_docs(spark, docs), table, block_terms=block_terms).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == ranked(docs, items)


def test_op11_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(as_docs(spark, [(1, "alpha1")]), items.filter("false")).count() == 0


def test_op11_leaves_masks_out():
    """Documents whose mask can't reach the best ones are not scored."""
    import numpy as np

    post = (np.array([0] * 50 + [1] * 2), np.array([*range(50), 3, 7]), None, None)
    impact = np.array([1] * 50 + [100] * 2)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    lexical_search._search_slice(post, impact, np.arange(50), [np.array([0, 1])], best, 2)
    assert best[0][0].tolist() == [101, 101] and best[0][1].tolist() == [3, 7]


# ---- divergence


def differences(rows, most=200):
    """Rows (lang, source, part, item, value, rank) by whole-number loops; rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        t = terms(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
        df[lang].update(set(t))
        count[lang, source].update(t)
        groups.add((lang, source))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for w, n in df[lang].items() if n >= 3]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(counts):
            n = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // (n + len(kept)) for w in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in sources if o != s]
            term = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[lang, s][w] > 0 and p[s][w] > q[w]]
            for part, values, limit in (("pair", pair, None), ("term", term, most)):
                ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("pass_terms,dense", [(4_000_000, 64 << 20), (50, 1000)])
def test_op13_equals_loops(spark, monkeypatch, pass_terms, dense):
    rng = random.Random(8)
    monkeypatch.setattr(source_divergence, "DENSE_BYTES", dense)
    rows = [(sentence(rng, rng.randint(1, 40)).translate(str.maketrans("0123456789", "abcdefghij")), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "ü", None])) for _ in range(250)]
    rows += [(None, "fr", "a"), ("one two", "fr", "b"), ("Äpfel ÄPFEL äpfel", "en", "c"), ("", "en", "empty"), ("solo", "it", "only"), rows[0], rows[0]]
    docs = spark.createDataFrame([(1, t, g, s, 5, "h") for t, g, s in rows], "doc_id long, text string, lang string, source string, n int, shard string").repartition(3)
    got = source_divergence.divergence(docs, most=25, shard_terms=64, pass_terms=pass_terms).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == differences(rows, 25)


def test_op13_empty_table_and_no_vocabulary(spark):
    assert source_divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([("x y", "en", "a"), ("z", "en", "b")], "text string, lang string, source string")
    assert sorted(map(tuple, source_divergence.divergence(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_op13_perfect_hash():
    import pyarrow as pa

    keys = pa.array([f"key{i}".encode() for i in range(5000)], pa.large_binary())
    stored, levels = source_divergence.PerfectHash.build(keys)
    table = source_divergence.PerfectHash(stored, levels)
    at = table.places(keys, source_divergence._key_hashes(keys))
    assert sorted(at.tolist()) == list(range(5000)) and stored.take(pa.array(at)).equals(keys)
    other = pa.array([f"other{i}".encode() for i in range(5000)], pa.large_binary())
    assert set(table.places(other, source_divergence._key_hashes(other)).tolist()) == {-1}
    same, levels = source_divergence.PerfectHash.build(pa.array([b"a", b"b"], pa.large_binary()))  # keys left after all levels are listed
    assert len(same) == 2


def test_op13_share_is_exact():
    import numpy as np

    counts, total = np.array([0, 1, 10**12, 4 * 10**16]), np.array([5 * 10**16 + 3])
    assert source_divergence._share(counts, total).tolist() == [1 + 10**9 * (c + 1) // (5 * 10**16 + 3) for c in counts.tolist()]
