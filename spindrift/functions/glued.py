"""Keys and tokens that stand right behind a word character, where a pattern with a word boundary does not see them.

What looks like a key's prefix also ends words (risk-, task-, pnpm_), so a find must have the shape of its kind. Finds are merged with
the long runs of base64 that they reach into; a find inside one run is left to the rule that masks such runs whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import KEYS

BLOB = re.compile(r"\b[A-Za-z0-9+/]{60,}={0,2}\b", re.ASCII)
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.([A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}")
_DIGIT, _UPPER, _LOWER = (re.compile(p) for p in ("[0-9]", "[A-Z]", "[a-z]"))


def _random(body: str) -> bool:
    return all(p.search(body) for p in (_DIGIT, _UPPER, _LOWER))


def _upper(body: str) -> bool:
    return bool(_UPPER.search(body))


#: What a body must look like where the prefix alone says too little; all other kinds need no more than their pattern.
SHAPES: dict[str, Callable[[str], bool]] = {
    "anthropic-key": lambda b: bool(re.match("[a-z]+[0-9]+-", b)) or _random(b), "openai-project-key": _upper, "stripe-key": lambda b: _random(b) and len(_DIGIT.findall(b)) > 1, "api-key": _random, "npm-token": _upper,
    "sendgrid-key": lambda b: b.find(".") == 22,
}
#: A body that differs behind a word character: words joined by underscores must not pass for it.
BODIES = {"github-token": "[A-Za-z0-9]{20}[A-Za-z0-9_]*"}
_FINDS = tuple((re.compile(f"{prefix}({BODIES.get(kind, body)})", re.ASCII), kind) for prefix, body, kind in KEYS)
#: Longest prefix; a body that is no key can end with the beginning of the next prefix.
_BACK = 11
#: Literals of which a text must hold one.
SIGNS = ("sk-", "sk_", "rk_", "pk_", "whsec_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "hf_", "SG.", "dop_v1_", "xox", "AKIA", "AIza", "eyJ")


def _is_json(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def finds(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that has the shape of a key or token, wherever it stands."""
    out = []
    for m in JWT.finditer(text):
        if _is_json(m[1]):
            out.append((m.start(), m.end(), "jwt"))
    for pattern, kind in _FINDS:
        at = 0
        while m := pattern.search(text, at):
            if SHAPES.get(kind, bool)(m[1]):
                out.append((m.start(), m.end(), kind))
                at = m.end()
            else:
                at = max(m.start() + 1, m.end() - _BACK)
    return sorted(out, key=lambda s: s[0])


def glued_spans(text: str) -> list[tuple[int, int, str]]:
    """Parts to mask, in order and apart: finds with the blob runs they overlap; a find within one run stays out, one that overlaps the last part joins it."""
    found = finds(text)
    if not found:
        return []
    blobs, out, b = [m.span() for m in BLOB.finditer(text)], [], 0
    for start, end, kind in found:
        while b < len(blobs) and blobs[b][1] <= start:
            b += 1
        over = [x for x in blobs[b : b + 1 + (end - start) // 60 + 1] if x[0] < end]
        if len(over) == 1 and over[0][0] <= start and end <= over[0][1]:
            continue
        if over:
            start, end = min(start, over[0][0]), max(end, over[-1][1])
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def mask_glued(text: str) -> tuple[str, list[str]]:
    """The text with each part replaced by its mark, and the parts' kinds."""
    out, at, kinds = [], 0, []
    for start, end, kind in glued_spans(text):
        out += [text[at:start], f"‹{kind}›"]
        kinds.append(kind)
        at = end
    return "".join(out) + text[at:], kinds


def without_glued(df: DataFrame, column: str, into: str, kinds: str = "glued_kinds") -> DataFrame:
    """``df`` with ``into`` (the column masked) and ``kinds`` (of its parts, in order). Texts without any sign never leave the JVM."""
    keep = df.columns
    there = F.lit(False)
    for sign in SIGNS:
        there = there | F.contains(F.col(column), F.lit(sign))
    there = F.coalesce(there, F.lit(False))
    fields = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), f"{into} string", f"{kinds} array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [mask_glued(t) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([t for t, _ in made], pa.string()), pa.array([k for _, k in made], pa.list_(pa.string()))], [*keep, into, kinds])

    rest = df.filter(~there).withColumns({into: F.col(column), kinds: F.array().cast("array<string>")})
    return df.filter(there).mapInArrow(run, fields).unionByName(rest)
