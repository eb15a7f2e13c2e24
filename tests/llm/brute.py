"""Plain re-computations of the text operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reachable(nodes, links):
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def base_measures(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if count[tuple(words[i: i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def without_repeats(texts):
    """(n_bytes, n_removed, n_spans, digest, remaining) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i: i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        cut = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if count[r[i: i + 200]] > 1:
                cut[i: i + 200] = True
        left = bytes(b for b, c in zip(r, cut) if not c)
        out.append((len(r), len(r) - len(left), int((np.diff(np.concatenate(([False], cut)).astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest(), left))
    return out


def fingerprint(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """{id: (fingerprint, component)} of (id, text) rows."""
    prints = {i: fingerprint(t) for i, t in rows}
    distinct = sorted(set(prints.values()))
    a = np.array(distinct, np.uint64)
    links = [(distinct[i], distinct[i + 1 + int(j)]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 2)]
    label = reachable(distinct, links)
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    return {i: (f"{p:016x}", least[label[p]]) for i, p in prints.items()}


def vector_links(rows, least):
    """{id: (links, component)} of (id, vector, label) rows."""
    fit = defaultdict(list)
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fit[label, len(v)].append((i, np.array(v, np.float64)))
    links = []
    for own in fit.values():
        ids = [i for i, _ in own]
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        links += [(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist())]
    degree = Counter(i for pair in links for i in pair)
    label = reachable([i for i, _, _ in rows], links)
    return {i: (degree[i], label[i]) for i, _, _ in rows}
