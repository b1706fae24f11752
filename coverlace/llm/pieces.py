"""Encoding texts match by match, through a bounded table of matches seen before.

The matches of a few megabytes of texts that the table lacks are encoded together, each distinct one once. The table has
two generations: when the younger is full it becomes the older, and what is met again moves up, so frequent matches stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Characters of texts whose new matches are encoded together, about.
TOGETHER = 4 << 20

#: In texts of these characters alone, PLAIN matches as the byte-level pattern does: the letters are these ranges, digits the
#: only numbers, white space the ASCII white space, and all others are punctuation.
OTHER = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ɏ]")
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[!-/:-@\[-`{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern``; the byte-level pattern has a quicker equal for most Latin texts."""
    import regex
    from public_tokenizers import PATTERN

    full = regex.compile(pattern).findall
    if pattern != PATTERN:
        return full
    other, plain = OTHER.search, PLAIN.findall
    return lambda text: full(text) if other(text) else plain(text)


class PieceTable:
    def __init__(self, find: Callable[[str], list[str]], encode: Callable[[list[bytes]], list[bytes]], bound: int = 600_000, longest: int = 64):
        self.find, self.encode, self.bound, self.longest = find, encode, bound, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.bound:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        get, find, join = young.__getitem__, self.find, b"".join
        out: list[bytes] = [b""] * len(texts)
        left = []  # texts with matches that the younger table lacks
        for k, t in enumerate(texts):
            matches = find(t)
            try:
                out[k] = join(map(get, matches))
            except KeyError:
                left.append((k, matches))
        met: set[str] = set()
        for _, matches in left:
            met.update(matches)
        new = []
        for m in met.difference(young):
            if m in old:
                young[m] = old[m]
            else:
                new.append(m)
        young.update(zip(new, self.encode([m.encode() for m in new])))
        for k, matches in left:
            out[k] = join(map(get, matches))
        for m in new:
            if len(m) > self.longest:
                del young[m]
        return out

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Encodings of whole texts, in order; null is empty."""
        some, size = [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= TOGETHER:
                yield from self._some(some)
                some, size = [], 0
        if some:
            yield from self._some(some)
