"""Short forms of long things: bounded lists, sizes, and distributions drawn in one line."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Fixed characters of a sparkline, by height, and of a bar.
HEIGHTS, FULL, EMPTY = "  ▂▃▄▅▆▇█", "█", "░"


def bounded(items: Iterable, limit: int = 20) -> dict:
    """The first ``limit`` items, with how many there are and how many are left out."""
    every = list(items)
    return {"total": len(every), "preview": every[:limit], "omitted": max(len(every) - limit, 0)}


def sizes_in_short(sizes: Iterable[int], limit: int = 20) -> dict:
    """Sizes, greatest first, as a bounded list with the largest, the singletons and four buckets."""
    every = sorted((int(s) for s in sizes if s > 0), reverse=True)
    buckets = {"1": (1, 1), "2-5": (2, 5), "6-20": (6, 20), ">20": (21, np.inf)}
    return bounded(every, limit) | {"largest": every[:5], "singleton_count": every.count(1), "size_buckets": {k: sum(a <= s <= b for s in every) for k, (a, b) in buckets.items()}}


def sparkline(counts: Iterable[int]) -> str:
    """One character a bin of a histogram."""
    c = np.asarray(list(counts), float)
    if not c.size:
        return ""
    top = c.max()
    return "".join(HEIGHTS[int(x)] for x in (c / top * (len(HEIGHTS) - 1) if top else c))


def bar(value: float, most: float, length: int = 10) -> str:
    """A bar of ``length`` characters filled in proportion."""
    filled = int(min(max(value / most, 0.0), 1.0) * length) if most > 0 else 0
    return FULL * filled + EMPTY * (length - filled)
