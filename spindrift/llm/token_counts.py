"""Operator 4: exact token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A text is cut into pieces as the vocabulary's pre-tokenizer does; special strings stand for themselves.
Within a piece the table of ``counts`` holds, for every prefix, the exact number of tokens that the
tokenizer gives that prefix: the last token of each prefix is unique, so the entry at i is one more
than the entry at i - len(last token). A candidate token may follow a prefix only if the merge order
would not have joined across that border. Pieces' tables are kept per worker in a bounded cache.
``PrefixCounts`` answers truncation and budget questions from the stored tables without encoding again.

Null text counts as empty: 0 bytes, 0 tokens. One row out for each row in, equal rows alike; extra
columns are not carried. Whole texts are counted, whatever their length.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the pattern by which byte-level vocabularies of this family cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space before a space, or a space at the start: chunks would not stand alone.
SPACED = re.compile(r"\s |^ ")


class Chunks(dict):
    """Tokens of a space and what follows it up to the next one."""

    def __init__(self, counter: PrefixCounts):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.counter.count, self.counter.pieces.findall(" " + chunk)))
        if len(self) < CACHE:
            self[chunk] = n
        return n


class PrefixCounts:
    """Counts of all prefixes, from the text of a tokenizer's JSON file."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        #: Rank of a merge by the ids of its halves; the halves of a token.
        self.rank, self.halves = {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[self.tokens[a] << 20 | self.tokens[b]] = r
            if self.halves.setdefault(self.tokens[a + b], (self.tokens[a], self.tokens[b], r))[2] != r:
                raise ValueError("two merges make one token; the table of borders needs a single one")
        self.pieces = regex.compile(PIECES)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spines: dict[int, list] = {}
        self.reachable: dict[int, bool] = {}
        self.border: dict[int, bool] = {}
        self.endings = ahocorasick.Automaton()
        for raw, i in self.tokens.items():
            if self.alone(i):
                self.endings.add_word(raw.decode("latin-1"), (len(raw), i))
        self.endings.make_automaton()
        self.cache: dict[str, int] = {}
        self.chunks = Chunks(self)

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The parts that stand at one side (1: right, 0: left) of a token while it is merged.

        With each part the rank of the merge that makes it and of the one that takes it in.
        """
        key = token << 1 | side
        found = self.spines.get(key)
        if found is None:
            found, until = [], 1 << 60
            while True:
                made = self.halves.get(token)
                found.append((token, made[2] if made else -1, until))
                if not made:
                    break
                token, until = made[side], made[2]
            self.spines[key] = found
        return found

    def first_across(self, left: int, right: int) -> int | None:
        """Rank of the first merge over the border of two tokens, None if they stay apart.

        Merges go by rank, leftmost first, and a merge ranks after those that made its halves. So two
        parts join if both stand at the border when their merge's turn comes.
        """
        rank, best = self.rank, None
        for a, a_from, a_until in self.spine(left, 1):
            for b, b_from, b_until in self.spine(right, 0):
                r = rank.get(a << 20 | b)
                if r is not None and a_from < r < a_until and b_from < r <= b_until and (best is None or r < best):
                    best = r
        return best

    def follows(self, left: int, right: int) -> bool:
        """Whether the tokens ``left`` and ``right`` stay apart side by side."""
        key = left << 20 | right
        found = self.border.get(key)
        if found is None:
            found = self.first_across(left, right) is None
            if len(self.border) < 4 * CACHE:
                self.border[key] = found
        return found

    def alone(self, token: int) -> bool:
        """Whether the merge order makes this token out of its own bytes."""
        found = self.reachable.get(token)
        if found is None:
            made = self.halves.get(token)
            found = not made or self.alone(made[0]) and self.alone(made[1]) and self.first_across(made[0], made[1]) == made[2]
            self.reachable[token] = found
        return found

    def counts(self, piece: str) -> list[int]:
        """Tokens of the first 0, 1, ... bytes of a piece."""
        n, last, border, done = [0], [-1], self.border, 0
        # Of the tokens that end at a byte the automaton gives longer ones first; one of them fits.
        for end, (size, token) in self.endings.iter(piece.encode().decode("latin-1")):
            if end < done:
                continue
            start = end + 1 - size
            if start:
                found = border.get(last[start] << 20 | token)
                if found is None:
                    found = self.follows(last[start], token)
                if not found:
                    continue
            n.append(n[start] + 1)
            last.append(token)
            done = end + 1
        return n

    def count(self, piece: str) -> int:
        found = self.cache.get(piece)
        if found is None:
            found = self.counts(piece)[-1]
            if len(self.cache) < CACHE:
                self.cache[piece] = found
        return found

    def split(self, text: str) -> Iterator[str]:
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                yield part
            elif part:
                yield from self.pieces.findall(part)

    def of_piece(self, piece: str) -> int:
        return 1 if piece in self.special else self.count(piece)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A piece never reaches over a space that has no white space before it, so the text falls into
        chunks that begin with such a space and are counted once each.
        """
        if SPACED.search(text):
            return sum(map(self.count, self.pieces.findall(text)))
        head, *rest = text.split(" ")
        return sum(map(self.count, self.pieces.findall(head))) + sum(map(self.chunks.__getitem__, rest))

    def total(self, text: str) -> int:
        """Tokens of a whole text."""
        if not self.split_special or not self.split_special.search(text):
            return self.plain(text)
        return sum(k % 2 or self.plain(part) for k, part in enumerate(self.split_special.split(text)))

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the pieces in code points, and the tokens up to each."""
        ends, sums = [0], [0]
        for piece in self.split(text):
            ends.append(ends[-1] + len(piece))
            sums.append(sums[-1] + self.of_piece(piece))
        return ends, sums

    def prefix(self, text: str, chars: int, table: tuple[list[int], list[int]]) -> int:
        """Tokens of ``text[:chars]``: the stored sum, then the tables of the cut pieces only.

        A cut changes at most the piece that it falls in and the one before it.
        """
        ends, sums = table
        k = max(0, bisect_right(ends, chars) - 2)
        return sums[k] + sum(self.of_piece(p) for p in self.split(text[ends[k] : chars]))

    def truncate(self, text: str, budget: int, table: tuple[list[int], list[int]]) -> int:
        """Code points of the longest run of whole pieces from the start with at most ``budget`` tokens."""
        return table[0][bisect_right(table[1], budget) - 1]


_loaded: dict[str, PrefixCounts] = {}


def _counter(path: str, shipped: str) -> PrefixCounts:
    if path not in _loaded:
        try:
            text = open(path, encoding="utf-8").read()
        except FileNotFoundError:
            text = open(SparkFiles.get(shipped), encoding="utf-8").read()
        _loaded[path] = PrefixCounts(text)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, budgets: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; for each budget b also chars_within_b, the code points that fit.

    ``vocabulary``: path of a byte-level BPE tokenizer file (JSON), on every worker or shipped with addFile.
    """
    names = [f"chars_within_{b}" for b in budgets]
    shipped = vocabulary.rsplit("/", 1)[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary, shipped)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if budgets:
                tables = [counter.table(t) for t in texts]
                totals = [sums[-1] for _, sums in tables]
            else:
                tables, totals = [], [counter.total(t) for t in texts]
            n = np.array(totals, np.int64)
            cut = [pa.array([counter.truncate(t, b, x) for t, x in zip(texts, tables)], pa.int64()) for b in budgets]
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit), *cut], names=["doc_id", "n_bytes", "n_tokens", "over_limit", *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean" + "".join(f", {n} long" for n in names)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
