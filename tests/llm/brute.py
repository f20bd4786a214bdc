"""Plain-Python versions of the operators' contracts, for small tables."""
import base64
import collections
import hashlib
import re

import numpy as np
import xxhash

CONTAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = CONTAM_WORD.findall(lower(t))
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])].add(str(i))
    out = []
    for i, t in docs:
        w = CONTAM_WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    found |= x
                    hit |= set(range(j, j + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def simhash(text):
    w = SHINGLE_WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_duplicates(docs, distance=3):
    fps = [simhash(t) for _, t in docs]
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= distance)
    least = {}
    for r, (i, _) in zip(root, docs):
        least[r] = min(least.get(r, i), i)
    return [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(docs, fps, root)]


def repeats(docs, length):
    count = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                cut[j : j + length] = True
        kept = bytes(x for x, c in zip(b, cut) if not c)
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((i, len(b), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def later_copies(docs, length):
    """(id, removed bytes) when the first copy of each string stays."""
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                cut[j : j + length] = True
            seen.add(b[j : j + length])
        out.append((i, int(cut.sum())))
    return out


def warc(pages):
    by = collections.defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    out = []
    for i, u, h in pages:
        data = (h or "").encode()
        first = max((x for x in by[h or ""] if x is not None), default=None)
        again = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, u, len(data), digest, "revisit" if again else "response", first if again else None, None if again else data))
    return out
