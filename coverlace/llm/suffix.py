"""Suffix arrays by induced sorting, in arrays.

Positions are classified as S or L by what follows; leftmost S positions are put into their symbols' buckets; one sweep
over the buckets upwards induces the L suffixes and one downwards the S suffixes. A sweep takes a bucket's entries
together: what they induce falls into later buckets, or into the same bucket's next round, in the order of a scan. Equal
leftmost-S substrings get equal names, and where names repeat, the string of names is sorted by recursion (a short one
by doubling); names
beyond a bucket table's size are written as two digits, whose order is the same.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is swept bucket by bucket.
MAX_SYMBOLS = 2048
#: Strings of names up to this length end the recursion: sweeping their buckets would cost more than sorting them (of 3.6
#: million bytes of op3's strings, 2.7 seconds instead of 7.7).
SHORT = 1 << 22


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right (S); the last symbol is the unique least."""
    up = t[1:] > t[:-1]
    change = t[1:] != t[:-1]
    n = len(t)
    nxt = np.where(change, np.arange(n - 1, dtype=np.int32), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return np.append(up[nxt], True)


def _sweep(t, want, symbols, sigma, counts, others, other_bounds, seeds=None) -> np.ndarray:
    """Entries of one type in bucket order, induced by what the sweep meets.

    ``symbols`` runs over the buckets in the sweep's order; ``want`` marks the positions of the type that is induced;
    ``others`` holds, by bucket, entries of the other type, which a bucket's own entries precede in the sweep.
    """
    out = np.empty(int(counts.sum()), np.int32)
    head = np.cumsum(counts) - counts
    fill = head.copy()
    if seeds is not None:
        for s in seeds:
            c = t[s]
            out[fill[c]] = s
            fill[c] += 1

    def push(q: np.ndarray) -> None:
        j = q - 1
        j = j[(j >= 0) & want[j]] if q.size and q.min() == 0 else j[want[j]]
        if not j.size:
            return
        c = t[j]
        if j.size < 8:
            for x, y in zip(c.tolist(), j.tolist()):
                out[fill[x]] = y
                fill[x] += 1
            return
        o = np.argsort(c, kind="stable")
        c = c[o]
        starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        k = np.diff(np.append(starts, len(c)))
        own = c[starts]
        out[np.repeat(fill[own] - starts, k) + np.arange(len(c))] = j[o]
        fill[own] += k

    for c in symbols:
        done = head[c]
        while done < fill[c]:
            now = fill[c]
            push(out[done:now])
            done = now
        a, b = other_bounds[c], other_bounds[c + 1]
        if a < b:
            push(others[a:b])
    return out


def _induce(t, is_s, sigma, lms_in_order) -> np.ndarray:
    """The suffix array that follows from the order given to the leftmost-S suffixes."""
    n = len(t)
    counts = np.bincount(t, minlength=sigma)
    count_l = np.bincount(t[~is_s], minlength=sigma)
    count_s = counts - count_l
    key = t[lms_in_order]
    lms = lms_in_order[np.argsort(key, kind="stable")]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=sigma))))
    used = np.flatnonzero(counts)
    big = _sweep(t, ~is_s, used, sigma, count_l, lms, bounds)
    by_l = np.concatenate(([0], np.cumsum(count_l)))
    # Downwards, a bucket's L entries are met from the right; they are laid out so that slices read that way.
    turned = big[np.repeat(by_l[:-1] + by_l[1:] - 1, count_l) - np.arange(len(big))]
    small = _sweep(t, is_s, used[::-1], sigma, count_s, turned, by_l, seeds=[n - 1])
    heads = np.cumsum(counts) - counts
    sa = np.empty(n, np.int32)
    sa[np.repeat(heads - by_l[:-1], count_l) + np.arange(len(big))] = big
    by_s = np.cumsum(count_s) - count_s
    sa[np.repeat(heads + counts + by_s, count_s) - 1 - np.arange(len(small))] = small
    return sa


def _names(t, lms, order) -> np.ndarray:
    """Names of the leftmost-S substrings in their sorted order: equal substrings share one."""
    length = np.empty(len(t), np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    at = np.flatnonzero(equal)
    k = 0
    while at.size:
        same = t[a[at] + k] == t[b[at] + k]
        equal[at[~same]] = False
        at = at[same]
        k += 1
        at = at[length[a[at]] > k]
    return np.concatenate(([0], np.cumsum(~equal)))


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array of a short string by ranks of twice as many symbols each round."""
    n, k = len(t), 1
    rank = t.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        sa = np.argsort(key)
        steps = np.cumsum(key[sa][1:] != key[sa][:-1])
        if steps[-1] == n - 1:
            return sa.astype(np.int32)
        rank[sa[0]], rank[sa[1:]] = 0, steps
        k *= 2


def _sais(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is its only 0."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(t, is_s, sigma, lms)
    order = sa[is_lms[sa]]
    names = _names(t, lms, order)
    top = int(names[-1]) + 1
    if top < len(lms):
        rank = np.empty(n, np.int32)
        rank[order] = names
        r = rank[lms]
        if len(r) <= SHORT:
            sub = _doubled(r)
        elif top <= MAX_SYMBOLS:
            sub = _sais(r.astype(np.uint16), top)
        else:
            bits = ((top - 1).bit_length() + 1) // 2
            digits = np.empty(2 * len(r) + 1, np.uint16 if bits < 16 else np.int32)
            digits[:-1:2], digits[1::2] = (r >> bits) + 1, (r & ((1 << bits) - 1)) + 1
            digits[-1] = 0
            sub = _sais(digits, (1 << bits) + 1)
            sub = sub[(sub & 1 == 0) & (sub < 2 * len(r))] >> 1
        order = lms[sub]
    return sa if np.array_equal(order, lms) else _induce(t, is_s, sigma, order)


def suffix_array(data: bytes | np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``data`` in lexicographic order."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    t = np.zeros(len(raw) + 1, np.uint16)
    t[:-1] = raw
    t[:-1] += 1
    return _sais(t, 257)[1:]


def plcp_at_least(raw: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each text position, whether it shares ``length`` bytes with the suffix before its own in ``sa``.

    Permuted: indexed by position, so the text is read in order and only the neighbour is looked up.
    """
    n = len(raw)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate((raw, np.zeros(length + 8, np.uint8)))
    words = np.ndarray((n + length,), "<u8", buffer=padded.tobytes(), strides=(1,))
    out = np.zeros(n, bool)
    at = np.arange(n, dtype=np.int32)
    at = at[(phi >= 0) & (at + length <= n) & (phi + length <= n)]
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else None
    if offsets is None:
        raise ValueError("common prefixes of at least 8 bytes are compared")
    for o in offsets:
        at = at[words[at + o] == words[phi[at] + o]]
    out[at] = True
    return out
