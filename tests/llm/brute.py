"""Plain versions of the operators' contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least id reachable over links of similarity 0.85)."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items, window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    owners = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            owners[tuple(w[i : i + size])].add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in owners}:
            for a in range(len(w) - size + 1):
                if found := owners.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def secret_spans(text: str | None) -> list[tuple[int, str, int]]:
    keys = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"""({keys}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(s, k, e) for s, _, k, e in sorted(out)]
