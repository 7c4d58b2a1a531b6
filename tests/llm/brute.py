"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

#: Words of 5-word shingles: runs of word characters.
WORDS = re.compile(r"\w+")


def shingles(text, k=5):
    w = WORDS.findall((text or "").lower())
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def near_classes(rows, similarity=0.8):
    """doc_id: least id of its class, over all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = sum((x & y).values())
            if x == y or both >= similarity * (sum(x.values()) + sum(y.values()) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d in parent}


def repeats(rows, n=100):
    """doc_id: (bytes, removed, runs, digest of what is left), over all positions."""
    seen, out = set(), {}
    for d, t in sorted((r for r in set(rows) if r[0] is not None)):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                covered[s : s + n] = b"\1" * n
            seen.add(b[s : s + n])
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[d] = (len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


def spread_lines(rows, sites):
    """doc_id: text without the lines that occur on so many distinct sites."""
    where = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                where.setdefault(line.strip(" "), set()).add(site)
    out = {}
    for d, text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(where.get(x.strip(" "), ())) < sites]
        out[d] = None if text is None else "\n".join(kept)
    return out
