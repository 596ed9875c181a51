"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WHITE = "\t\n\x0b\x0c\r "
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, k, percent=80):
    """{doc_id: component} over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def lines(rows, min_chars=40, min_docs=5):
    """{doc_id: (n_lines, n_dropped, text)}."""
    key = lambda x: x.strip(WHITE).translate(UPPER)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    keep = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if keep.get(key(x), i) == i]
        out[i] = (len(all_), len(all_) - len(kept), "\n".join(kept))
    return out


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def contamination(text, items, window=10):
    """(n_words, n_hit, sorted item ids)."""
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        own = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in own:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


SECRETS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def secrets(text):
    return sorted(((m.start(), n, m.end()) for n, (_, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m)))
