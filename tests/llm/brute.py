"""The definitions, as plainly as can be, over lists of (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(docs):
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs):
    """{doc_id: (fingerprint, component)}; ids are unique."""
    f = [fingerprint(t) for _, t in docs]
    a, ids, up = np.array(f, np.uint64), [i for i, _ in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(range(len(docs)), key=lambda i: ids[i])
    rank = {i: r for r, i in enumerate(order)}
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist():
            x, y = sorted((root(i), root(j)), key=rank.get)
            up[y] = x
    return {ids[i]: (f"{f[i]:016x}", ids[root(i)]) for i in range(len(docs))}


def repeats(docs, window=20):
    seen, out = set(), {}
    for d, t in ordered(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        keep = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(keep).encode()).hexdigest())
    return out


def rules(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    r = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
    return (*r, r[0] < 50 or 100 * r[4] > 50 * r[0])


def judged(docs, sources):
    """{doc_id: text} of the documents that their rules and hosts let pass."""
    m = {d: rules(t) for d, t in docs.items()}
    lines = {d: sum(bool(WORD.search(x)) for x in (t or "").split("\n")) for d, t in docs.items()}
    fails = {d: (x[5], 100 * x[2] > 20 * x[0], 100 * x[3] > 30 * lines[d], 10 * x[1] < 20 * x[0] or 10 * x[1] > 120 * x[0]) for d, x in m.items()}
    n, strict, bad = Counter(sources.values()), set(), set()
    for r in range(4):
        k = Counter({h: 0 for h in n} | Counter(sources[d] for d in docs if fails[d][r]))
        total = sum(n.values())
        mean = sum(k.values()) / total
        spread = sum(k[h] ** 2 / n[h] for h in n) / total - mean**2 - mean * (1 - mean) * len(n) / total
        s = min(max(mean * (1 - mean) / spread - 1, 1), 100) if spread > 0 else 100
        for h in n:
            p = (k[h] + mean * s) / (n[h] + s)
            sd = (p * (1 - p) / (n[h] + s + 1)) ** 0.5
            if p - 1.96 * sd > 0.5:
                bad.add(h)
            if p - 0.5 * sd > mean:
                strict.add((h, r))
    return {d: t for d, t in docs.items() if not m[d][5] and sources[d] not in bad and not any(f and (sources[d], r) in strict for r, f in enumerate(fails[d]))}


KINDS = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def secrets(text):
    return sorted((m.start(), o, m.end(), k) for o, (k, r, g, n) in enumerate(KINDS) for m in r.finditer(text or "") if len(m[g]) >= n)


def masked(text):
    out, at = [], 0
    for a, _, z, k in secrets(text):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def edits_within(p, t):
    """The least edits between p and any part of t."""
    row = np.zeros(len(t) + 1, np.int64)
    c = np.frombuffer(t.encode("utf-32-le"), "<u4")
    for x in np.frombuffer(p.encode("utf-32-le"), "<u4"):
        step = np.minimum(row[:-1] + (c != x), row[1:] + 1)
        new = np.concatenate(([row[0] + 1], step))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def crc(text):
    return zlib.crc32((text or "").encode())
