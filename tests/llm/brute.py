"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re

import numpy as np


def removed(docs, length=50):
    """doc -> (bytes, mark of removed bytes) for [(id, text)]; a null id is above all."""
    big = 1 << 62
    first = {}
    rows = [(big if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, big), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        out.append((b, gone))
    return out


def removal_row(doc_id, b, gone):
    spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
    return (doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())


def simhash(text, k=3):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(docs, errors=3):
    f = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= errors:
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            groups[find(k)] = min(groups.get(find(k), i), i)
    return [(i, f"{f[k]:016x}", groups.get(find(k))) for k, (i, _) in enumerate(docs)]


def backoff(docs, order=3, factor=0.4):
    from collections import Counter

    words = [(t or "").encode().lower().split() for _, t in docs]
    grams = [[Counter(tuple(w[i - k : i + 1]) for i in range(k, len(w))) for k in range(order)] for w in words]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    n = sum(map(len, words))
    out = []
    for (doc, _), w, own in zip(docs, words, grams):
        count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i in range(len(w)):
            f, v = 1.0, None
            for k in range(min(order - 1, i), -1, -1):
                g = tuple(w[i - k : i + 1])
                if count(g) > 0:
                    v = f * count(g) / (count(g[:-1]) if k else n - len(w))
                    break
                if k:
                    f *= factor
            score += np.log10(v if v is not None else f / (n - len(w) + 1))
        out.append((doc, len(w), score))
    return out
