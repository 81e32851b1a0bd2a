"""Small documents tables and plain models of the operators."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def docs(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, source), with columns whose names could clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", "1 as row", "'x' as version", "2 as copy", "3 as key", "4 as rank", "true as kept")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


def near_groups(rows, n, percent):
    """doc_id -> (set size, smallest reachable id), by comparing all that share a shingle."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for d in sorted(sets):
        met = Counter(o for s in sets[d] for o in seen[s])
        for s in sets[d]:
            seen[s].append(d)
        for o, c in met.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[o]) - c):
                a, b = root(d), root(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}
