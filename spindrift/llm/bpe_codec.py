"""Operator 2: BPE encoding and decoding through a table of distinct words.

Blocks of consecutive rows send their distinct words (runs without ASCII white space, which the
tokenizer drops anyway) to word buckets; each bucket encodes each distinct word once for the whole
corpus and sends the ids back to the blocks that asked; there ids are joined to the words' positions,
and decoding joins ids to the pieces of the vocabulary, whose size the tokenizer file fixes.
What moves: each text once, compressed, and each distinct word of a block, so that no row per word
position is ever shuffled. A block holds at most ``block_mb`` of text or one longer text: a task cuts its
rows by their bytes, long and short ones together, so that a table has few blocks and few words twice. A
block's words for one bucket are one row; there are never more such rows than distinct words of blocks.

Null text counts as empty: no tokens, the empty text decoded. Equal rows give equal rows, one out for
each in; a null id is kept. Extra columns are not carried. A table of no rows gives none.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

_tokenizers: dict = {}


def vocabulary_text(path: str) -> str:
    try:
        return open(path, encoding="utf-8").read()
    except FileNotFoundError:
        return open(SparkFiles.get(path.rsplit("/", 1)[-1]), encoding="utf-8").read()


def tokenizer_of(path: str):
    """The tokenizer of a JSON file that is on every worker or was shipped with addFile."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each of the library's threads would keep memory of its own
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary_text(path))
        cut = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}])[0]
        if spec.get("decoder") is not None or cut.get("type") != "WhitespaceSplit" and (cut.get("behavior"), cut.get("invert")) != ("Removed", True):
            raise ValueError(f"{path}: it doesn't drop white space between words, or its decoding isn't joining by spaces")
        found = Tokenizer.from_str(vocabulary_text(path))
        found.no_truncation()
        found.no_padding()
        _tokenizers[path] = found
    return _tokenizers[path]


def pieces_of(path: str) -> dict[bytes, bytes]:
    """The piece of each id (both as text in UTF-8), without a tokenizer in memory."""
    if (path, "pieces") not in _tokenizers:
        spec = json.loads(vocabulary_text(path))
        found = {str(i).encode(): t.encode() for t, i in spec["model"]["vocab"].items()}
        found |= {str(t["id"]).encode(): t["content"].encode() for t in spec["added_tokens"]}
        del spec
        release()
        _tokenizers[path, "pieces"] = found
    return _tokenizers[path, "pieces"]


def pack(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(parts))


def unpack(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """id, text and where the row stands (file, row); and about how many MB of text there are."""
    one = lambda df: df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        rows = one(docs)
    except AnalysisException:  # not a table of files: blocks must be the same in both scans, so it becomes one
        rows = one(materialize(docs.select(id_col, text_col), "bpe-input"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    return rows, math.ceil((size or 0) / 1e6)


def runs(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in order, cut into blocks of up to ``most`` bytes of text or one longer text; a block may be several batches.

    Both scans have the same columns, so the same tasks, and cut alike.
    """
    block, size = None, 0
    for batch in batches:
        begin = 0
        for k, n in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
            if block is None or size and size + n > most:
                if k > begin:
                    yield block, batch.slice(begin, k - begin)
                begin, size = k, 0
                block = xxhash.xxh3_64_intdigest(f"{batch.column('file')[k]}:{batch.column('row')[k]}") - 2**63
            size += n
        if batch.num_rows > begin:
            yield block, batch.slice(begin)


def distinct_words(buckets: int, most: float):
    def send(block: int, words: set[bytes]) -> pa.RecordBatch:
        parts: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in words:
            parts[zlib.crc32(w) % buckets].append(w)
        rows = [(k, block, pack(sorted(p))) for k, p in enumerate(parts) if p]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "block", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, set()
        for block, part in runs(batches, most):
            if block != now:
                if words:
                    yield send(now, words)
                    release()
                now, words = block, set()
            for text in part.column("text"):
                words.update(text.as_buffer().to_pybytes().split())
        if words:
            yield send(now, words)

    return run


def encode_bucket(path: str):
    """Of one bucket's rows: each distinct word is encoded once, then every row gets its words' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, ids_of, asked = tokenizer_of(path), {}, []

        def encode(words: list[bytes]) -> None:
            for k in range(0, len(words), 2_000):  # what the tokenizer returns takes about a kilobyte a word
                part = words[k : k + 2_000]
                for w, e in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)):
                    ids_of[w] = " ".join(map(str, e.ids)).encode()

        for batch in batches:
            for block, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                encode([w for w in unpack(blob) if w not in ids_of])
                asked.append((block, blob))
        release()
        for block, blob in asked:
            ids = pack([ids_of[w] for w in unpack(blob)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary()), pa.array([ids], pa.binary())], names=["block", "words", "ids"])

    return run


def pack_texts(id_type: pa.DataType, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in runs(batches, most):
            texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            sizes = np.array(list(map(len, texts)), np.int64)
            ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part.column("id").cast(id_type))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([sizes.tobytes()], pa.binary()), pa.array([blob], pa.binary())], names=["block", "ids", "sizes", "texts"])

    return run


def numbered(path: str, dictionary: pa.Table) -> tuple[dict[bytes, int], pa.Array, pa.Array, pa.Array]:
    """The number of each word of a block; and by number, its ids and pieces as text, a space behind each, and its ids."""
    pieces, number = pieces_of(path), {}
    flat, counts, texts, sizes = [], [], ([], []), ([], [])
    for words, ids in zip(dictionary["words"], dictionary["ids"]):
        for w in unpack(words.as_py()):
            number[w] = len(number)
        each = [i.split() for i in unpack(ids.as_py())]
        counts.append(np.fromiter(map(len, each), np.int64, len(each)))
        flat.append(np.array([x for parts in each for x in parts], np.int32))
        for text, size, rows in zip(texts, sizes, (each, ([pieces[x] for x in parts] for parts in each))):
            spaced = [b" ".join([*parts, b""]) for parts in rows]
            size.append(np.fromiter(map(len, spaced), np.int64, len(spaced)))
            text.append(b"".join(spaced))
        del each, spaced
    upto = lambda parts: np.concatenate([[0], np.cumsum(np.concatenate(parts))])
    as_text = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(upto(size)), pa.py_buffer(b"".join(text))]) for text, size in zip(texts, sizes)]
    as_lists = pa.ListArray.from_arrays(pa.array(upto(counts), pa.int32()), pa.array(np.concatenate(flat)))
    return number, *as_text, as_lists


def join_back(path: str, with_ids: bool, with_text: bool, most: int = 1 << 20):
    """Of one block: its dictionary and its texts, some ``most`` bytes at a time; ids go to the words' positions."""

    def joined(doc_ids: pa.Array, words: list[int], ends: list[int], ids: pa.Array, pieces: pa.Array, lists: pa.Array) -> pa.Table:
        at = pa.array(words, pa.int64())
        columns, texts = {"doc_id": doc_ids}, {}
        for name, some in (("ids", ids), ("decoded", pieces)):
            taken = some.take(at)
            offsets, data = np.frombuffer(taken.buffers()[1], np.int64)[ends], memoryview(taken.buffers()[2] or b"")
            texts[name] = [data[a : max(a, b - 1)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        taken = lists.take(at)
        upto = np.frombuffer(taken.buffers()[1], np.int32)[ends]
        columns["n_tokens"] = pa.array(np.diff(upto).astype(np.int64))
        for name in texts:
            columns[f"{name}_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts[name]], pa.string())
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), taken.values)
        if with_text:
            columns["decoded"] = pa.array([str(t, "utf-8") for t in texts["decoded"]], pa.string())
        return pa.table(columns)

    def run(key, dictionary: pa.Table, packed: pa.Table) -> pa.Table:
        number, *by_number = numbered(path, dictionary)
        done = []
        for ids, sizes, blob in zip(packed["ids"], packed["sizes"], packed["texts"]):
            raw, at, began, first = zstandard.ZstdDecompressor().decompress(blob.as_buffer()), 0, 0, 0
            words, ends = [], [0]
            all_sizes = np.frombuffer(sizes.as_buffer(), np.int64).tolist()
            for k, size in enumerate(all_sizes, 1):
                words += map(number.__getitem__, raw[at : at + size].split())
                ends.append(len(words))
                at += size
                if at - began >= most or k == len(all_sizes):
                    done.append(joined(ids.values.slice(first, k - first), words, ends, *by_number))
                    words, ends, began, first = [], [0], at, k
            del raw
        done = pa.concat_tables(done)
        del number, by_number
        release()
        return done

    return run


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_mb: float = 24, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids (array), ``with_text`` decoded (text).

    Ids are those of the tokenizer in ``vocabulary`` (JSON) without added special tokens, truncation or
    padding; the decoded text is that of its ``decode(ids, skip_special_tokens=False)``. The tokenizer
    must drop white space and cut at it, and have no decoder, as word-level BPE vocabularies do.
    """
    rows, mb = in_blocks(docs, id_col, text_col)
    buckets = max(4, math.ceil(mb / block_mb))
    asked = rows.mapInArrow(distinct_words(buckets, block_mb * 1e6), "bucket int, block long, words binary")
    answered = asked.repartition(buckets, "bucket").mapInArrow(encode_bucket(vocabulary), "block long, words binary, ids binary")
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    packed = rows.mapInArrow(pack_texts(to_arrow_type(kind), block_mb * 1e6), f"block long, ids array<{kind.simpleString()}>, sizes binary, texts binary")
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return answered.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(join_back(vocabulary, with_ids, with_text), schema)
