"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

The tree's leaves are the byte positions of one pattern match; a leaf holds the rank of the pair that starts there
(or nothing), an inner node the leftmost minimum of its leaves. Each merge takes the root's position, joins the token
there with its live right neighbour, and makes point updates at the merged position, at the swallowed one and at the
live left neighbour, so a match of n bytes costs O(n log n) however long it is. Matches of up to 64 bytes are encoded
together: one array holds a tree per row, and every step makes one merge in each row that has one left.

Cases: a null text counts as empty; an empty text has no ids and decodes to nothing; repeated rows give repeated
results; an empty table gives an empty result; further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coverlace.llm.common import EMPTY
from coverlace.llm.pieces import PieceTable, splitter

NONE = np.int64(1) << 62
#: Longest match that is encoded in step with others.
LOCKSTEP = 64
_SCATTER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank and merged id, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(3 * len(key) + 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE >> 8)
        self.ids = np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            own, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[own], self.ranks[own], self.ids[own] = key[placed], rank[placed], merged[placed]
            done = np.zeros(len(key), bool)
            done[placed] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.id_of_rank = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.id_of_rank[rank] = merged

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * _SCATTER >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a number above all ranks where there is no merge."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(len(key), NONE >> 8)
        at = np.arange(len(key))
        while len(at):
            found = self.keys[slot]
            hit = found == key[at]
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Byte tokens, merges and the bytes of every id. ``whole``: matches that are one token as they stand."""

    def __init__(self, token_id: dict[bytes, int], merges: tuple[np.ndarray, ...], whole: bool):
        self.pairs = PairTable(*merges)
        self.scalar = {(int(a), int(b)): (int(r), int(i)) for a, b, r, i in zip(*merges)}
        self.byte_id = np.array([token_id[bytes([b])] for b in range(256)], np.int32)
        self.whole = token_id if whole else {}
        self.bytes_of = [b""] * (max(token_id.values()) + 1)
        for token, i in token_id.items():
            self.bytes_of[i] = token

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """From lines of a base64 token and its rank: any two tokens merge whose joined bytes are a token."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        found = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        return cls(ranks, tuple(np.array(x, np.int64) for x in zip(*found)), whole=True)

    @classmethod
    def from_merges(cls, path: str) -> Vocabulary:
        """From a tokenizer's JSON: the listed pairs merge, in the order of the list."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        token_id = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
        table = np.array([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)], np.int64).T
        return cls(token_id, tuple(table), whole=False)

    def encode_one(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        n = len(piece)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, (n - 1).bit_length())
        none = int(NONE)
        tree = [none] * (2 * size)
        get, id_of = self.scalar.get, self.pairs.id_of_rank
        for i in range(n - 1):
            if found := get((ids[i], ids[i + 1])):
                tree[size + i] = found[0] << 32 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = size + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        def pair(i: int, j: int) -> int:
            found = get((ids[i], ids[j]))
            return found[0] << 32 | i if found else none

        while tree[1] != none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = int(id_of[tree[1] >> 32]), -1
            k = after[i] = after[j]
            put(j, none)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [x for x in ids if x >= 0]

    def _in_step(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has; no piece is longer than ``size``."""
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        live = np.arange(size) < n[:, None]
        ids = np.full((m, size), -1, np.int32)
        ids[live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 1, dtype=np.int8), (m, size)).copy()
        before = after - 2
        tree = np.full((m, 2 * size), NONE)
        both = live[:, 1:]
        row, col = np.nonzero(both)
        rank = self.pairs.rank_of(ids[row, col], ids[row, col + 1])
        tree[row, size + col] = rank << 8 | col
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        flat_tree, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        limit = (NONE >> 8) << 8

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            base = row * (2 * size)
            k = size + leaf
            flat_tree[base + k] = value
            while True:
                k = k >> 1
                if k[0] == 0:
                    break
                flat_tree[base + k] = np.minimum(flat_tree[base + 2 * k], flat_tree[base + 2 * k + 1])

        row = np.flatnonzero(tree[:, 1] < limit)
        while len(row):
            top = flat_tree[row * (2 * size) + 1]
            i = top & 255
            at = row * size
            j = flat_after[at + i].astype(np.int64)
            flat_ids[at + i] = self.pairs.id_of_rank[top >> 8]
            flat_ids[at + j] = -1
            k = flat_after[at + j].astype(np.int64)
            flat_after[at + i] = k
            put(row, j, np.full(len(row), NONE))
            inside = k < n[row]
            flat_before[(at + k)[inside]] = i[inside]
            value = np.full(len(row), NONE)
            value[inside] = self.pairs.rank_of(flat_ids[(at + i)[inside]], flat_ids[(at + k)[inside]]) << 8 | i[inside]
            put(row, i, value)
            h = flat_before[at + i].astype(np.int64)
            left = h >= 0
            if left.any():
                r, g = row[left], h[left]
                put(r, g, self.pairs.rank_of(flat_ids[r * size + g], flat_ids[r * size + i[left]]) << 8 | g)
            row = row[flat_tree[row * (2 * size) + 1] < limit]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def encode_many(self, pieces: list[bytes], dtype: str = "<u4") -> list[bytes]:
        """Ids of each match, as bytes of ``dtype``."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            one = self.whole.get(piece)
            if one is not None:
                out[k] = np.array([one], dtype).tobytes()
            elif len(piece) > LOCKSTEP:
                out[k] = np.array(self.encode_one(piece), dtype).tobytes()
            elif piece:
                by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        width = np.dtype(dtype).itemsize
        for size, own in by_size.items():
            for a in range(0, len(own), 1 << 15):
                part = own[a : a + (1 << 15)]
                ids, counts = self._in_step([pieces[k] for k in part], size)
                raw = ids.astype(dtype).tobytes()
                stops = (np.cumsum(counts) * width).tolist()
                for k, lo, hi in zip(part, [0, *stops], stops):
                    out[k] = raw[lo:hi]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def byte_letters() -> str:
    """The 256 printable letters that stand for bytes in byte-level vocabularies, by byte: printable Latin-1 characters
    stand for themselves, the others for the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_merges(path) if path.endswith(".json") else Vocabulary.from_ranks(path)


@functools.lru_cache(maxsize=4)
def piece_table(path: str, pattern: str, dtype: str) -> PieceTable:
    v = vocabulary(path)
    return PieceTable(splitter(pattern), lambda pieces: v.encode_many(pieces, dtype))


EMPTY.append(piece_table.cache_clear)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``; ``path`` must exist on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = piece_table(path, pattern, "<u4"), vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in table.texts(batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and its ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path, pattern, "<u4")
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in table.texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids (bytes that are no UTF-8 become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
