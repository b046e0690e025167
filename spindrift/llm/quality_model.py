"""Operator 1: a quality classifier on random-indexing word vectors.

Random indexing: each word (hashed into ``BUCKETS`` rows) has a fixed sparse index vector, +1 in one
dimension and -1 in another. A word's vector is the sum of the index vectors of its neighbours, up to
two words to either side, over every document of the corpus. Tasks sum their part, the parts are added
chunk by chunk as they stream by, and the finished table (its size is fixed by ``BUCKETS`` and ``DIMS``)
is small enough to send to all tasks. A document is the mean of its words' vectors beside a few shape
statistics; a two-layer network gives its score, and a temperature fitted on held-back training rows
calibrates it.

Null and empty texts have a document vector of zeros and get the score that the network gives it. One
row out for each row in; equal texts get equal scores; a null id is kept (and counts as not held out);
extra columns are not carried. With no labelled rows, or one class only, the score is the share of
label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .secret_scan import slices

BUCKETS, DIMS, CHUNKS, REACH = 16384, 48, 16, 2
STATS = 10


def _index() -> tuple[np.ndarray, np.ndarray]:
    """The two dimensions of each bucket's index vector."""
    h = textkernel.mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(77))
    plus = (h % np.uint64(DIMS)).astype(np.int64)
    minus = ((h >> np.uint64(20)) % np.uint64(DIMS - 1)).astype(np.int64)
    return plus, np.where(minus >= plus, minus + 1, minus)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIMS, np.int64)
    plus, minus = _index()
    for batch in batches:
        for part in slices(batch):
            h, _, _, first = textkernel.words_of(part.column(1), lower=False)
            b = (h % np.uint64(BUCKETS)).astype(np.int64)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for k in range(1, REACH + 1):
                near = owner[k:] == owner[:-k]
                for word, other in ((b[k:][near], b[:-k][near]), (b[:-k][near], b[k:][near])):
                    total += np.bincount(word * DIMS + plus[other], minlength=len(total))
                    total -= np.bincount(word * DIMS + minus[other], minlength=len(total))
    yield from _chunks(total)


def _chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = total.reshape(CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    for chunk, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors, rows of length 1, gathered from every document."""
    parts = docs.select(F.lit(0).alias("i"), F.col(text_col).alias("text")).mapInArrow(_gather, "chunk int, sums binary")
    # First among a few tasks each, then one task per chunk: no task reads more than the square root of all parts.
    salted = parts.repartition(CHUNKS * 8, "chunk", F.pmod(F.spark_partition_id(), F.lit(8))).mapInArrow(_add, "chunk int, sums binary")
    rows = salted.repartition(CHUNKS, "chunk").mapInArrow(_add, "chunk int, sums binary").collect()
    table = np.zeros((CHUNKS, BUCKETS * DIMS // CHUNKS), np.int64)
    for r in rows:
        table[r.chunk] += np.frombuffer(r.sums, np.int64)
    table = table.reshape(BUCKETS, DIMS).astype(np.float64)
    table = np.sign(table) * np.sqrt(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and shape statistics of each text."""
    data, offsets = textkernel.buffer_of(texts)
    starts, ends = textkernel.word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    h = textkernel.word_hashes(data, starts, ends, lower=False)
    n = np.diff(first)
    docs = len(n)
    owner = np.repeat(np.arange(docs), n)
    x = np.zeros((docs, DIMS + STATS), np.float32)
    if len(h):
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        full = np.flatnonzero(n)
        for k in range(0, DIMS, 8):
            x[full, k : k + 8] = np.add.reduceat(vectors[bucket, k : k + 8], first[full], axis=0) / n[full, None]
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    windows, at = textkernel.window_hashes(h, first, 5)
    ids = np.repeat(np.arange(docs), np.diff(at))
    once = lambda values, who: np.bincount(who[_first_of(values, who)], minlength=docs)
    x[:, DIMS] = np.log1p(n) / 5
    x[:, DIMS + 1] = once(h, owner) / np.maximum(n, 1)
    x[:, DIMS + 2] = once(windows, ids) / np.maximum(np.diff(at), 1)
    x[:, DIMS + 3] = sums((data >= 65) & (data <= 90)) / size
    x[:, DIMS + 4] = sums((data >= 48) & (data <= 57)) / size
    x[:, DIMS + 5] = sums(_SIGNS[data]) / size
    x[:, DIMS + 6] = sums(data == 10) / size * 10
    x[:, DIMS + 7] = size / np.maximum(n, 1) / 10
    x[:, DIMS + 8] = sums((data == 46) | (data == 44)) / np.maximum(n, 1)
    x[:, DIMS + 9] = n < 10
    return x


_SIGNS = np.zeros(256, bool)
_SIGNS[[*b"#*$%&|<>!@^~_=+{}[]\\"]] = True


def _first_of(values: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Positions of one of each (who, value)."""
    order = np.lexsort((values, who))
    v, w = values[order], who[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    return order[new]


class Network:
    """tanh layer and logistic output, standardised inputs, calibrated by a temperature."""

    def __init__(self, seed: int = 5, hidden: int = 32):
        self.seed, self.hidden, self.temperature, self.constant = seed, hidden, 1.0, None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, decay: float = 1e-3) -> Network:
        if len(y) < 20 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.RandomState(self.seed)
        x, y = x.astype(np.float64), y.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        d = x.shape[1]
        self.w1, self.b1 = rng.randn(d, self.hidden) / np.sqrt(d), np.zeros(self.hidden)
        self.w2, self.b2 = rng.randn(self.hidden) / np.sqrt(self.hidden), 0.0
        z = (x - self.mean) / self.scale
        params = [self.w1, self.b1, self.w2, np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        best = (np.inf, None)
        for _ in range(epochs):
            rng.shuffle(train)
            for k in range(0, len(train), batch):
                rows = train[k : k + batch]
                a = np.tanh(z[rows] @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30)))
                g = (p - y[rows]) / len(rows)
                da = np.outer(g, params[2]) * (1 - a * a)
                grads = [z[rows].T @ da + decay * params[0], da.sum(0), a.T @ g + decay * params[2], np.array([g.sum()])]
                t += 1
                for i, grad in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad**2
                    params[i] = params[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            loss = self._loss(np.tanh(z[held] @ params[0] + params[1]) @ params[2] + params[3], y[held])
            if loss < best[0]:
                best = (loss, [p.copy() for p in params])
        self.w1, self.b1, self.w2, self.b2 = (*best[1][:3], float(best[1][3][0]))
        logits = self.logit(x[held])
        self.temperature = float(min(np.geomspace(0.3, 5, 60), key=lambda s: self._loss(logits / s, y[held])))
        return self

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - y * logit))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 12_000) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on at most ``train_rows`` labelled rows.

    Rows come by hash order; those with crc32(id) mod 5 = 0 are held out and never looked at.
    """
    vectors = word_vectors(docs, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    sample = known.filter(~held_out("id")).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = document_features(part.column(1), vectors)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    rows = texts.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, x binary").toPandas().sort_values(["x", "label"])
    x = np.frombuffer(b"".join(rows.x), np.float32).reshape(len(rows), DIMS + STATS) if len(rows) else np.zeros((0, DIMS + STATS), np.float32)
    return vectors, Network().fit(x, rows.label.to_numpy())


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted (1 from ``threshold`` on)."""
    vectors, network = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = network.score(document_features(part.column(1), vectors))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
