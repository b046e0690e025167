"""Operator 11: ranked lexical search by presence masks.

Every item of a query set is matched against every document. The items go to all tasks in blocks of at most
``block_terms`` terms, which is measured before anything is sent; each block reads the documents twice, once
to count (documents, terms, documents with each of the block's terms), once to search.

A task searches slices of documents. For an item it marks, for each document of the slice, which of the
item's terms are there: a bit mask. Documents with one mask form a group. A mask's score is at most the sum
of the largest parts that its terms give anywhere in the slice, so the masks are taken from the highest such
bound down, in growing steps, and only their documents are scored; the rest is left as soon as the next bound
is below the item's k-th best score so far, which the task carries from slice to slice. What is left out could
not be among the best. Each task then gives k rows an item at most, which are ranked together.

Null texts and texts without terms have no terms and do not count as documents. Every row of the documents is
one document, so repeated rows rank beside each other; a null doc_id comes after all others of its score.
Repeated rows of an item are one item, two texts under one item id are two. Items without terms, or with
terms that no document has, give no rows. Columns that the operator does not read may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import ALNUM, byte_slices, terms_of

NULL_ID = np.iinfo(np.int64).max
SLICE_BYTES = 8 << 20


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms, first = terms_of(b.column("text"), ALNUM)
        lists = [sorted(set(terms[a:z].to_pylist())) for a, z in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("key"), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "key", "terms"])


def _count(vocabulary: pa.Array):
    """Documents with a term (-1), terms (-2) and documents with each term of the block, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for b in batches:
            texts = b.column(0)
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                t, d, _, n = _postings(texts.slice(lo, hi - lo), vocabulary)
                df += np.bincount(t, minlength=len(vocabulary))
                n_docs += int((n > 0).sum())
                n_terms += int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]).astype(np.int64)), pa.array(np.concatenate([[n_docs, n_terms], df[some]]).astype(np.int64))], ["term", "n"])

    return run


def _postings(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences) sorted by term and document, and the number of all terms of each document."""
    terms, first = terms_of(texts, ALNUM)
    n = np.diff(first)
    found = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(found >= 0)
    doc = np.repeat(np.arange(len(n)), n)[at]
    pairs, tf = np.unique(found[at].astype(np.int64) * max(len(n), 1) + doc, return_counts=True)
    return pairs // max(len(n), 1), pairs % max(len(n), 1), tf.astype(np.int64), n


def _better(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then least id."""
    return np.lexsort((ids, -score))[:k]


def _search_slice(post: tuple, impact: np.ndarray, ids: np.ndarray, items: list[np.ndarray], best: list, k: int) -> None:
    """Bring ``best`` (scores and ids of each item) up to date with one slice of documents."""
    t, d, _, _ = post
    n_docs = len(ids)
    present, at = np.unique(t, return_index=True)
    upto = np.append(at[1:], len(t))
    most = np.maximum.reduceat(impact, at)
    where = dict(zip(present.tolist(), range(len(present))))
    for i, item in enumerate(items):
        own = [where[x] for x in item.tolist() if x in where]
        if not own:
            continue
        # Bit j % 64 of word j // 64 of a document's mask: the item's j-th term is there.
        masks = np.zeros((-(-len(own) // 64), n_docs), np.uint64)
        for j, p in enumerate(own):
            masks[j // 64, d[at[p] : upto[p]]] |= np.uint64(1 << (j % 64))
        docs = np.flatnonzero(masks.any(0))
        if len(masks) == 1:
            kinds, group = np.unique(masks[0, docs], return_inverse=True)
            kinds = kinds[None, :]
        else:
            kinds, group = np.unique(masks[:, docs], axis=1, return_inverse=True)
        bound = np.zeros(kinds.shape[1], np.int64)
        for j, p in enumerate(own):
            bound += np.where(kinds[j // 64] >> np.uint64(j % 64) & np.uint64(1), most[p], 0)
        by_bound = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        begin = np.append(0, np.cumsum(np.bincount(group, minlength=len(bound))))
        score, keep = best[i]
        done, step = 0, 8
        while done < len(by_bound):
            least = score[-1] if len(score) == k else 1
            chosen = by_bound[done : done + step]
            chosen = chosen[bound[chosen] >= least]
            if not len(chosen):
                break
            part = docs[np.concatenate([members[begin[g] : begin[g + 1]] for g in chosen])]
            part.sort()
            total = np.zeros(len(part), np.int64)
            for p in own:
                has = d[at[p] : upto[p]]
                spot = np.searchsorted(has, part)
                spot[spot == len(has)] = 0
                total += np.where(has[spot] == part, impact[at[p] + spot], 0)
            some = total > 0
            all_scores, all_ids = np.concatenate([score, total[some]]), np.concatenate([keep, ids[part[some]]])
            order = _better(all_scores, all_ids, k)
            score, keep = all_scores[order], all_ids[order]
            done, step = done + step, step * 2
        best[i] = (score, keep)


def _search(vocabulary: pa.Array, weight: np.ndarray, n_docs: int, n_terms: int, items: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for b in batches:
            texts, all_ids = b.column("text"), b.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                post = t, d, tf, n = _postings(texts.slice(lo, hi - lo), vocabulary)
                if len(t):
                    m = 100 - 90 + (90 * n * n_docs) // n_terms
                    impact = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
                    _search_slice(post, impact, all_ids[lo:hi], items, best, k)
        size = [len(s) for s, _ in best]
        ids = np.concatenate([x for _, x in best]) if best else none
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(items)), size)), pa.array(ids, mask=ids == NULL_ID), pa.array(np.concatenate([s for s, _ in best]) if best else none)], ["item", "doc_id", "score"]
        )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of each item."""
    item_type = items.schema["item_id"].dataType.simpleString()
    keyed = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("key", F.xxhash64("text"))
    sets = materialize(keyed.mapInArrow(_item_terms, f"item_id {item_type}, key long, terms array<binary>").filter("size(terms) > 0"), "items")
    total, largest = sets.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    most = max(2 * block_terms, largest + block_terms)  # an item is never split
    n_blocks = max(1, -(-total // block_terms))
    block = F.pmod(F.xxhash64("item_id", "key"), F.lit(n_blocks))
    while n_blocks > 1 and sets.groupBy(block.alias("b")).agg(F.sum(F.size("terms")).alias("n")).agg(F.max("n")).first()[0] > most and n_blocks < total:
        n_blocks *= 2
        block = F.pmod(F.xxhash64("item_id", "key"), F.lit(n_blocks))
    found = None
    for number in range(n_blocks):
        rows = sets.filter(block == number).orderBy("item_id", "key").collect()  # at most ``most`` terms
        if not rows and n_blocks > 1:
            continue
        part = _search_block(docs, [(r.item_id, r.key, [bytes(x) for x in r.terms]) for r in rows], item_type, k)
        found = part if found is None else found.unionByName(part)
    if n_blocks > 1:
        found = materialize(found, "found")
    best = Window.partitionBy("item_id", "key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: list[tuple], item_type: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    schema = f"item_id {item_type}, key long, doc_id long, score long"
    if not block:
        return spark.createDataFrame([], schema)
    words = sorted({w for *_, terms in block for w in terms})
    place = {w: i for i, w in enumerate(words)}
    vocabulary = pa.array(words, pa.large_binary())
    count = docs.select("text").mapInArrow(_count(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = dict(map(tuple, count.collect()))  # one row a term of the block
    n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
    if not n_docs:
        return spark.createDataFrame([], schema)
    df = [counts.get(i, 0) for i in range(len(words))]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
    items = [np.array([place[w] for w in terms], np.int64) for *_, terms in block]
    found = docs.select("doc_id", "text").mapInArrow(_search(vocabulary, weight, n_docs, n_terms, items, k), "item long, doc_id long, score long")
    names = spark.createDataFrame([(n, i, key) for n, (i, key, _) in enumerate(block)], f"item long, item_id {item_type}, key long")
    return found.join(F.broadcast(names), "item").select("item_id", "key", "doc_id", "score")
