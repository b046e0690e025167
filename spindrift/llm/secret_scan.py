"""Operator 9: secret scans with a linear-chain conditional random field.

Base rules find three kinds of secrets by pattern. Beside them a CRF tags the tokens of a text, in the
order in which they stand, as begin, inside or outside of a secret. Features are a token's shape (length,
classes of characters, their mix), the words beside it (the name of a secret up to three tokens before,
a sign of assignment between) and the file (whether it assigns to such names, its share of digits).
Weights are fitted here by gradient ascent on the likelihood. Training chains are runs of adjacent tokens
like those decoded: around base spans, which are the labels, and elsewhere, of at most ``train_rows``
documents by the order of a hash, each read whole; and copies of such runs into which a name and a made
value are put (letters, digits or both; passphrases of the text's own words), or a name and plain words,
so that values which the patterns don't see are found and prose about secrets is left alone.

Decoding covers every token of every whole text. A token is left out of the arithmetic only where its
shape's bound on the emission (a table by classes of characters and length, made from the weights)
proves it outside in every best path; Viterbi runs, exactly, over the runs of the other tokens.

Null text counts as empty: no spans. One row out for each row in; a null id is kept; extra columns are
not carried. Positions are code points, ends exclusive. No documents to fit on: no spans but the base ones.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import release

KINDS = ("assign", "access", "hex")
#: Fixed: the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api_key", "apikey")

#: Token characters; quotes, signs of assignment and brackets cut.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.-", *range(128, 256)]] = True
_DIGIT, _UPPER, _HEXCH, _LOWERC, _HIGH = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = _UPPER[65:91] = _LOWERC[97:123] = _HIGH[128:] = True
_HEXCH[48:58] = _HEXCH[97:103] = True
_ASSIGNS = np.zeros(256, bool)
_ASSIGNS[[*b"=:"]] = True

#: Names of secrets: a token that ends in one (an ending of up to two bytes aside) names what follows.
TITLES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "bearer", "private_key", "access_key")
NEAR = 3  # tokens after a name that know of it

#: Bits of the classes of a token's characters.
LOWER, UPPER, DIGIT, MARK, HIGH = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[*b"+/_.-"]], _CLASS[128:] = LOWER, UPPER, DIGIT, MARK, HIGH
LENGTHS = np.array([6, 8, 12, 16, 20, 32, 48])
#: Features that classes and length give; those that a token's bytes give; those of its place.
SHAPE = ("bias", *(f"length {n}" for n in LENGTHS), "lower", "upper", "digit", "mark", "high", "lower and upper", "lower and digit", "upper and digit", "all three", "letters only", "digits only", "lower only, 12")
FINE = ("hex", "hex of both", "digits, a fourth", "changes", "capitals inside", "AKIA")
PLACE = (*(f"name {k} before" for k in range(1, NEAR + 1)), "name before, assigned", "name, assigned farther", "beside the last", "file has names", "file of digits")
N = len(SHAPE) + len(FINE) + len(PLACE)


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Numbers of the texts with 24 hex characters in a row (or that may have: a run may span two texts)."""
    stops = np.concatenate([[-1], np.flatnonzero(~_HEXCH[data]), [len(data)]])
    runs = np.flatnonzero(np.diff(stops) > 24)
    owner = lambda at: np.searchsorted(offsets, at, "right") - 1
    return {k for a, b in zip(owner(stops[runs] + 1).tolist(), owner(stops[runs + 1] - 1).tolist()) for k in range(a, b + 1)}


def base_spans(text: str, may_have_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if may_have_hex:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = (*KINDS, "crf")) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the tokens of a batch, and the first token of each text."""
    inside = _TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def shape_table() -> tuple[np.ndarray, np.ndarray]:
    """Features of each (classes, length) code, and of each code which of FINE and PLACE a token may have."""
    code = np.arange(32 * 8)
    mask, bucket = code >> 3, code & 7
    has = lambda m: (mask & m) == m
    only = lambda m: (mask & ~m) == 0
    shape = [np.ones(len(code)), *(bucket > k for k in range(len(LENGTHS)))]
    shape += [has(m) for m in (LOWER, UPPER, DIGIT, MARK, HIGH, LOWER | UPPER, LOWER | DIGIT, UPPER | DIGIT, LOWER | UPPER | DIGIT)]
    shape += [only(LOWER | UPPER), only(DIGIT), only(LOWER) & (bucket > 2)]
    mixed = (mask & (mask - 1)) != 0
    may = [only(LOWER | DIGIT), has(LOWER | DIGIT) & only(LOWER | DIGIT), has(DIGIT), mixed, has(LOWER | UPPER), only(UPPER | DIGIT) & has(UPPER), *[code >= 0] * len(PLACE)]
    return np.array(shape, float).T, np.array(may, float).T


_SHAPES, _MAY = shape_table()


class Tokens:
    """The tokens of a batch of texts: places, shape codes, and which follow a name."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = tokens_of(data, offsets)
        n = len(self.starts)
        if n:
            masks = np.bitwise_or.reduceat(_CLASS[data], self.starts)
            self.codes = masks.astype(np.int64) * 8 + np.searchsorted(LENGTHS, self.ends - self.starts, "right")
        else:
            self.codes = np.zeros(0, np.int64)
        self.name_at = self._names()
        digits = np.concatenate([np.zeros(1, np.int32), np.cumsum(_DIGIT[data], dtype=np.int32)])
        self.of_digits = (digits[offsets[1:]] - digits[offsets[:-1]]) > 0.05 * np.maximum(np.diff(offsets), 1)

    def _names(self) -> np.ndarray:
        """Numbers of the tokens that name a secret."""
        low, found = textkernel.LOWER[self.data].tobytes(), set()
        for title in TITLES:
            name, at = title.encode(), -1
            while (at := low.find(name, at + 1)) >= 0:
                k = int(np.searchsorted(self.starts, at, "right")) - 1
                if k >= 0 and at + len(name) <= self.ends[k] <= at + len(name) + 2:
                    found.add(k)
        return np.array(sorted(found), np.int64)

    def after_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens up to NEAR after a name in the same text, how far the name is, and whether a sign of assignment stands between."""
        if not len(self.name_at):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        names = np.repeat(self.name_at, NEAR)
        away = np.tile(np.arange(1, NEAR + 1), len(self.name_at))
        at = names + away
        ok = at < len(self.starts)
        names, away, at = names[ok], away[ok], at[ok]
        ok = np.searchsorted(self.first, names, "right") == np.searchsorted(self.first, at, "right")
        names, away, at = names[ok], away[ok], at[ok]
        signs = np.array([b"=" in gap or b":" in gap for gap in (self.data[self.ends[a] : min(self.starts[t], self.ends[a] + 64)].tobytes() for a, t in zip(names, at))], bool)
        return at, away, signs

    def features(self, some: np.ndarray) -> np.ndarray:
        """All features of some tokens."""
        x = np.zeros((len(some), N))
        if not len(some):
            return x
        x[:, : len(SHAPE)] = _SHAPES[self.codes[some]]
        s, n = self.starts[some], self.ends[some] - self.starts[some]
        at = np.concatenate([[0], np.cumsum(n)])
        flat = self.data[np.repeat(s - at[:-1], n) + np.arange(at[-1])]
        count = lambda mask: np.add.reduceat(mask.astype(np.int64), at[:-1])
        kind = _CLASS[flat]
        digit, lower, hexch = count(kind == DIGIT), count(kind == LOWER), count(_HEXCH[flat])
        change = np.concatenate([[False], kind[1:] != kind[:-1]])
        inner = np.concatenate([[False], (kind[1:] == UPPER) & (kind[:-1] == LOWER)])
        change[at[:-1]] = inner[at[:-1]] = False
        akia = np.array([self.data[a : a + 4].tobytes() == b"AKIA" for a in s]) & ((_MAY[self.codes[some]][:, 5]) > 0)
        x[:, len(SHAPE) : len(SHAPE) + len(FINE)] = np.array([hexch == n, (hexch == n) & (digit > 1) & (lower > 1), digit * 4 >= np.maximum(n, 4), np.minimum(count(change), 12) / 12, count(inner) > 1, akia]).T
        place = len(SHAPE) + len(FINE)
        near, away, signs = self.after_names()
        where = np.searchsorted(some, near)
        hit = (where < len(some)) & (some[np.minimum(where, len(some) - 1)] == near)
        for w, k, sign in zip(where[hit], away[hit], signs[hit]):
            x[w, place + k - 1] = 1
            if sign:
                x[w, place + NEAR + (k > 1)] = 1
        owner = np.searchsorted(self.first, some, "right") - 1
        before = np.maximum(some - 1, 0)
        x[:, place + NEAR + 2] = (some > self.first[owner]) & (s - self.ends[before] == 1) & ~_SPACE[self.data[np.maximum(s - 1, 0)]]
        assigned = np.zeros(len(self.offsets), bool)
        assigned[np.searchsorted(self.first, near[signs], "right") - 1] = True
        x[:, place + NEAR + 3], x[:, place + NEAR + 4] = assigned[owner], self.of_digits[owner]
        return x


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Crf:
    """Tags 0 outside, 1 begin, 2 inside. ``weights``: features by (begin, inside); ``moves``: 3 by 3."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(x), 1)), x.astype(float) @ self.weights], axis=1)

    def open_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each shape code, whether a token of it may be inside of a secret: without a name near it, and with one.

        Another tag than outside changes two moves; what they can gain at most, and what the features that
        the code leaves open can add at most, is added to the code's own emission.
        """
        m = self.moves
        gain = np.array([max(m[a, x] + m[x, b] - m[a, 0] - m[0, b] for a in range(3) for b in range(3)) for x in (1, 2)])
        above = np.maximum(self.weights[len(SHAPE) :], 0)
        apart = above.copy()
        apart[len(FINE) : len(FINE) + NEAR + 2] = 0
        own = _SHAPES @ self.weights[: len(SHAPE)] + gain
        return tuple((own + _MAY @ rest).max(1) >= -1e-9 for rest in (apart, above))

    def open_tokens(self, tokens: Tokens) -> np.ndarray:
        """Numbers of the tokens that are not proved to be outside."""
        alone, named = self.open_codes()
        near = np.unique(tokens.after_names()[0])
        return np.union1d(np.flatnonzero(alone[tokens.codes]), near[named[tokens.codes[near]]])

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of a run of tokens between two outside ones."""
        score, back = e[0] + self.moves[0], []
        for row in e[1:]:
            step = score[:, None] + self.moves
            back.append(step.argmax(0))
            score = step.max(0) + row
        tag = int((score + self.moves[:, 0]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def decode(self, tokens: Tokens) -> list[tuple[int, int]]:
        """(first, last) token of each secret."""
        at = self.open_tokens(tokens)
        if not len(at):
            return []
        e = self.emissions(tokens.features(at))
        owner = np.searchsorted(tokens.first, at, "right")
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner) > 0)) + 1
        found = []
        for a, b in zip([0, *breaks], [*breaks, len(at)]):
            tags, begun = self.viterbi(e[a:b]), None
            for k, tag in enumerate([*tags, 0]):
                if tag != 2 and begun is not None:
                    found.append((int(at[a + begun]), int(at[a + k - 1])))
                    begun = None
                if tag == 1 or tag == 2 and begun is None:
                    begun = k
        return found

    @staticmethod
    def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.3, decay: float = 3e-6) -> Crf:
        """Likelihood ascent (Adam, with a falling rate) over chains of (features, tags), run side by side.

        Forward and backward sums are scaled at every token.
        """
        w, m = np.zeros((N, 2)), np.zeros((3, 3))
        w[0] = -4.0
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
        width = max(len(t) for _, t in chains)
        x = np.zeros((width, len(chains), N), np.float32)
        tags = np.zeros((width, len(chains)), int)
        live = np.zeros((width, len(chains)), bool)
        for k, (f, t) in enumerate(chains):
            x[: len(t), k], tags[: len(t), k], live[: len(t), k] = f, t, True
        flat, total = x.reshape(-1, N), live.sum()
        hot = (np.eye(3)[tags] * live[..., None]).astype(np.float32)
        seen_moves = np.einsum("tbi,tbj->ij", hot[:-1], hot[1:])
        for step in range(1, rounds + 1):
            e = np.zeros((width, len(chains), 3))
            e[..., 1:] = (flat @ w.astype(np.float32)).reshape(width, -1, 2)
            top = np.exp(e - e.max(2, keepdims=True))
            p_move, alpha, beta, scale = np.exp(m), np.zeros_like(top), np.ones_like(top), np.ones(top.shape[:2])
            for t in range(width):
                a = top[t] if not t else np.where(live[t, :, None], (alpha[t - 1] @ p_move) * top[t], alpha[t - 1])
                scale[t] = a.sum(1)
                alpha[t] = a / scale[t, :, None]
            for t in range(width - 2, -1, -1):
                a = (top[t + 1] * beta[t + 1]) @ p_move.T / scale[t + 1, :, None]
                beta[t] = np.where(live[t + 1, :, None], a, 1.0)
            p = alpha * beta
            p = (p / p.sum(2, keepdims=True) * live[..., None]).astype(np.float32)
            ahead = top[1:] * beta[1:] / scale[1:, :, None] * live[1:, :, None]
            moves = p_move * (alpha[:-1].reshape(-1, 3).T @ ahead.reshape(-1, 3))
            gw = flat.T @ (hot - p).reshape(-1, 3)[:, 1:] / total - decay * w
            gm = (seen_moves - moves) / total - decay * m
            for value, grad, a, b in ((w, gw, state[0], state[1]), (m, gm, state[2], state[3])):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                value += rate * (1 - step / (rounds + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return Crf(w, m)


CHAIN = 24


def _made(rng: random.Random, words: list[str], kinds: tuple[str, ...]) -> str:
    """A value as secrets have it: of one of the kinds that are not held back, or of letters."""
    draw = lambda letters, a, b: "".join(rng.choices(letters, k=rng.randint(a, b)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    plain = [w for w in words if w.isascii() and w.isalpha() and len(w) > 2] or ["plain", "words"]
    made = [draw(low + up + dig, 12, 44), draw(low + up, 12, 40), draw(low + up + dig + "+/", 20, 60), draw(low, 14, 28), "".join(rng.choices(plain, k=rng.randint(3, 5))).lower()[:40], draw(low + dig, 8, 24)]
    return rng.choice(made + [draw("0123456789abcdef", 24, 48)] * ("hex" in kinds) + ["AKIA" + draw(up + dig, 16, 16)] * ("access" in kinds))


def _planted(text: str, rng: random.Random, kinds: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """A copy of a piece of text with a name in it, and a made value beside it or none; and where the value is."""
    words = text.split(" ")
    at, name = rng.randint(0, len(words)), rng.choice(TITLES)
    name = rng.choice([name, name.capitalize(), name.upper(), "db_" + name])
    before = " ".join(words[:at]) + " " + name
    if rng.random() < 0.5:  # prose: plain words follow
        return before + rng.choice([" ", " is ", ": ", "s ", ", "]) + " ".join(words[at:]), []
    sign, value = rng.choice([" = ", "=", ": ", " is ", " ", ': "', "='"]), _made(rng, words, kinds)
    return before + sign + value + rng.choice([" ", '" ', "; "]) + " ".join(words[at:]), [(len(before) + len(sign), len(before) + len(sign) + len(value))]


def chains_of(text: str, kinds: tuple[str, ...], most: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training chains of one text: (features, tags) of adjacent tokens, at most ``most`` around its base spans, one anywhere, one around the longest other token, two made ones."""
    out, rng = [], random.Random(text[:200])

    def add(text: str, secrets: list[tuple[int, int]], pick: int, around: bool) -> None:
        raw = text.encode()
        tokens = Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
        if not len(tokens.starts):
            return
        place = np.cumsum((tokens.data & 0xC0) != 0x80) - 1
        begins, tags = place[tokens.starts], np.zeros(len(tokens.starts), int)
        for a, b in secrets:
            inside = np.flatnonzero((begins >= a) & (begins < b))
            tags[inside] = 2
            tags[inside[:1]] = 1
        marked = np.flatnonzero(tags == 1)
        middles = rng.sample(marked.tolist(), min(pick, len(marked))) if around else [rng.randrange(len(tags)), int(np.where(tags, 0, tokens.ends - tokens.starts).argmax())][:pick]
        for k in middles:
            some = np.arange(max(0, k - CHAIN // 2), min(len(tags), k + CHAIN // 2))
            out.append((tokens.features(some), tags[some]))

    spans = [(ASSIGN.match(text, a).start(2) if k == 0 else a, b) for a, k, b in base_spans(text) if KINDS[k] in kinds]
    if spans:
        add(text, spans, most, True)
    add(text, spans, 2, False)
    if text:
        for _ in range(2):
            at = rng.randrange(len(text))
            piece = text[max(0, at - 150) : at + 150]
            if not base_spans(piece):
                made, secrets = _planted(piece, rng, kinds)
                add(made, secrets, 1, bool(secrets))
    return out


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = 2000, kinds: tuple[str, ...] = KINDS) -> Crf:
    """Fit on chains of at most ``train_rows`` different texts, those with the least hashes, each read whole.

    ``kinds``: base kinds whose spans are labels; one that is left out is neither labelled nor made.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    least = [r.h for r in texts.select("h").distinct().orderBy("h").limit(train_rows).collect()]
    if not least:
        return Crf(np.full((N, 2), -9.0), np.zeros((3, 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                chains = chains_of(text.as_py(), kinds)
                if chains:  # features are parts of twelve
                    x, t = [np.round(f * 12).astype(np.uint8).tobytes() for f, _ in chains], [t.astype(np.uint8).tobytes() for _, t in chains]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(t, pa.binary())], names=["x", "t"])

    sample = texts.filter(F.col("h") <= least[-1]).dropDuplicates(["h"]).select("t")
    rows = sorted((bytes(r.t), bytes(r.x)) for r in sample.mapInArrow(run, "x binary, t binary").collect())
    chains = [(np.frombuffer(x, np.uint8).reshape(-1, N) / 12, np.frombuffer(t, np.uint8).astype(int)) for t, x in rows]
    if not any(t.any() for _, t in chains):
        return Crf(np.full((N, 2), -9.0), np.zeros((3, 3)))
    return Crf.fit(chains)


def scan(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """doc_id, carried columns, n_assign, n_access, n_hex, base_spans, spans (kind:start:end lists), redacted (``with_text``)."""
    weights, moves = model.weights, model.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(weights, moves)
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                data, offsets = textkernel.buffer_of(batch.column(1))
                tokens = Tokens(data, offsets)
                extra: dict[int, list[tuple[int, int]]] = {}
                for a, b in crf.decode(tokens):
                    owner = int(np.searchsorted(tokens.first, a, "right")) - 1
                    extra.setdefault(owner, []).append((int(tokens.starts[a] - offsets[owner]), int(tokens.ends[b] - offsets[owner])))
                with_hex = hex_runs(data, offsets)
                rows: list[list] = [[], [], [], [], [], []]
                for k, text in enumerate(texts):
                    base = base_spans(text, k in with_hex)
                    spans = list(base)
                    if k in extra:
                        raw = text.encode()
                        for a, b in extra[k]:
                            a, b = len(raw[:a].decode()), len(raw[:b].decode())
                            if not any(s < b and a < e for s, _, e in base):
                                spans.append((a, 3, b))
                        spans.sort()
                    for kind in range(3):
                        rows[kind].append(sum(s[1] == kind for s in base))
                    rows[3].append(spans_text(base))
                    rows[4].append(spans_text(spans))
                    rows[5].append((redact(text, spans) if batch.column(1)[k].is_valid else None) if with_text else "")
                out = [pa.array(r, pa.int64()) for r in rows[:3]] + [pa.array(r, pa.string()) for r in rows[3:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *out], names=["doc_id", *carry, "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "n_assign long, n_access long, n_hex long, base_spans string, spans string, redacted string"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text (column 1) each; a longer text is a part alone."""
    _, offsets = textkernel.buffer_of(batch.column(1))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
    release()


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [SECRET]."""
    out, at, upto = [], 0, -1
    for a, _, b in spans:
        if a >= upto:
            out += [text[at:a], "[SECRET]"]
        upto = at = max(upto, b)
    return "".join(out) + text[at:] if spans else text

