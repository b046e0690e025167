"""Vectorised splitting and hashing of texts, for use inside Arrow batches.

Words are runs of anything but ASCII white space. A word's hash is a polynomial over its bytes modulo
2**64 with a random odd base and a random 64-bit number per byte, then mixed; it is the same in every
process. Work goes over blocks of the batch's bytes, so that memory follows the block and not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK = 1 << 20
_rng = np.random.RandomState(20240117)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n + 1:
        size = max(n + 1, BLOCK + 1)
        for name, base in (("p", _BASE), ("inv", pow(_BASE, -1, 2**64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["p"], _powers["inv"]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a text's end also ends a word."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word; with ``lower``, A-Z count as a-z."""
    out = np.zeros(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = int(starts[k])
        upto = max(int(np.searchsorted(ends, at + BLOCK, "right")), k + 1)
        block = data[at : int(ends[upto - 1])]
        power, inverse = _tables(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[block] if lower else block] * power[: len(block)], out=sums[1:])
        s, e = starts[k:upto] - at, ends[k:upto] - at
        out[k:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        k = upto
    return mix(out)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their starts and ends in the batch's bytes, and the first word of each text (n + 1)."""
    data, offsets = buffer_of(texts)
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends, lower), starts, ends, np.searchsorted(starts, offsets)


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words inside each text, and the first window of each text.

    A text with fewer words, but some, has one window: its whole sequence.
    """
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    total = np.zeros(len(starts), np.uint64)
    for j in range(size):
        total += padded[starts + j] * _ORDER[j]
    with np.errstate(over="ignore"):
        for t in short:
            total[at[t]] = (padded[first[t] : first[t + 1]] * _ORDER[: n_words[t]]).sum() + _ORDER[63] * np.uint64(n_words[t])
    return mix(total), at


#: Which bytes belong to terms: letters and, with digits, digits; bytes of other than ASCII characters always do.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True


def terms_of(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch (maximal runs of the bytes in ``inside``, A-Z lower-cased) and the first term of each text (n + 1)."""
    data, offsets = buffer_of(texts)
    keep = inside[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = keep[cuts]
    starts, body = np.flatnonzero(first), LOWER[data[keep]]
    at = np.append(np.cumsum(keep, dtype=np.int64)[starts] - 1, len(body)) if len(starts) else np.zeros(1, np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])
    return terms, np.searchsorted(starts, offsets)


def byte_slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(first, end) rows of slices that hold ``most`` bytes of text or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(np.frombuffer(pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes(), np.int64))
    out, at = [], 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        upto = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
        out.append((at, upto))
        at = upto
    return out
