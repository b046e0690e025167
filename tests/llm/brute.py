"""Plain forms of the operators' results, for small inputs."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(docs, percent=75):
    """id -> (set size, least id reachable); docs: list of (id, text)."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i in parent}


def counts(text):
    t = text or ""
    w = words(t, lower=False)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    covered = {i + j for i, g in enumerate(win) if c[g] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def base_spans(text):
    t, out = text or "", []
    name = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token"))
    for m in re.finditer(rf"""({name}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), "assign", m.end())] * (len(m[2]) >= 6)
    for m in re.finditer("AKIA[A-Z0-9]+", t):
        out += [(m.start(), "access", m.end())] * (len(m[0]) >= 20)
    for m in re.finditer("[0-9a-f]+", t):
        out += [(m.start(), "hex", m.end())] * (len(m[0]) >= 24)
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda s: (s[0], order.index(s[1]))))


def repeated_runs(docs, size=50):
    """Ids of documents with a run of ``size`` words that another document has too."""
    where = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            where[tuple(w[k : k + size])].add(i)
    return set().union(*[v for v in where.values() if len(v) > 1], set())
