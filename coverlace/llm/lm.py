"""Stupid-backoff scores of documents under the corpus' own n-gram counts.

The count table is partitioned by the n-grams' hash. Each shard of documents explodes its texts into n-grams of all
orders and sends every distinct one with its count to the bucket of its hash; a bucket sums the counts of all shards, so
a frequent n-gram arrives once a shard and not once a place; the totals are joined back to the shard's n-grams and summed
per document. All of a document's counts are taken without the document itself, else nothing would ever back off:

    S(w | context) = count(context w) / count(context)   if count(context w) > 0
                   = BACKOFF * S(w | shorter context)     otherwise;   S(w) = count(w) / N, unseen: 1 / (N + 1)

Words are lower-cased (A-Z) runs of bytes without ASCII white space. Cases: a null text counts as empty; a text without
words has sum and mean 0; very long texts are read block by block, and a word longer than a block is one word; contexts do not reach over a document's start; repeated rows count as documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coverlace.llm.common import n_shards_for, pack_sorted, releasing, sharded, text_bytes, unpack_sorted

ORDER = 3
BACKOFF = 0.4
SHARD_BYTES = 6 << 20
BLOCK = 1 << 20
#: Bits of an n-gram's hash, at every size, so that a count does not depend on how large the corpus is: among 10**12
#: different n-grams one meets another by chance about once in 70,000 cases. (All 64 would take 0.6 x the input more of
#: shuffle than the check tool allows; see the README.)
KEY_BITS = 56
#: The value under which shards send their number of words.
TOTAL = np.uint64(0)

_TABLE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)
_P = 0xD1342543DE82EF95
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """One hash per word of lower-cased ``data``, from sums of powers that the word's place is divided out of."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def document_words(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents in order, and the number of each one's words."""
    longest = min(max(map(len, datas), default=0), BLOCK) + 1
    up, down = _powers(_P, longest), _powers(pow(_P, -1, 1 << 64), longest)
    out, n = [], []
    for data in datas:
        data, k, at = data.lower(), 0, 0
        while at < len(data):
            end = min(len(data), at + BLOCK)
            if end < len(data):
                cut = max(data.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:  # a word longer than a block
                    tail = next((i for i in range(end, len(data)) if _SPACE[data[i]]), len(data))
                    w = np.array([hash_long(data[at:tail])], np.uint64)
                    end = tail
                else:
                    end = cut
                    w = word_hashes(data[at:end], up, down)
            else:
                w = word_hashes(data[at:end], up, down)
            out.append(w)
            k += len(w)
            at = end
        n.append(k)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(n, np.int64)


def hash_long(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.strip(b" \n\t\r\x0b\x0c"), 1)


class Grams:
    """N-grams of a shard's documents: per order k the value of the k-gram that ends at each word, and which exist."""

    def __init__(self, table: pa.Table, order: int, bits: int = KEY_BITS):
        ids = table["doc_id"].to_pylist()
        datas = [b"" if x is None else x for x in table["text"].cast(pa.large_binary()).to_pylist()]
        rank = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, datas[i]))
        self.ids = [ids[i] for i in rank]
        words, self.n = document_words([datas[i] for i in rank])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        shift = np.uint64(64 - bits)
        values, self.exists, h = [], [], np.zeros(len(words), np.uint64)
        for k in range(order):
            before = np.concatenate((np.zeros(min(k, len(words)), np.uint64), words[: max(0, len(words) - k)]))
            h = mix(h * _MIX2 + before + np.uint64(k + 1))
            values.append(np.maximum(h >> shift, np.uint64(1)))
            self.exists.append(place >= k)
        self.distinct, inverse, self.count = np.unique(np.concatenate([v[e] for v, e in zip(values, self.exists)]), return_inverse=True, return_counts=True)
        sizes = [int(e.sum()) for e in self.exists]
        self.index = np.split(inverse, np.cumsum(sizes)[:-1])  # per order, of the existing grams

    def by_bucket(self, buckets: int):
        bucket = (self.distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            yield b, order[bounds[b] : bounds[b + 1]]


SENT = "bucket int, shard int, a binary, b binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["bucket", "shard", "a", "b"])


def _squeeze(x: np.ndarray) -> bytes:
    """Counts, mostly ones: columns of bytes, compressed."""
    raw = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(raw).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(raw.T).view("<u8").ravel().astype(np.int64)


def _sum_counts(t: pa.Table) -> pa.Table:
    values = [unpack_sorted(x) for x in t["a"].to_pylist()]
    n = [len(v) for v in values]
    counts = np.concatenate([_unsqueeze(x, k) for x, k in zip(t["b"].to_pylist(), n)])
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    total = np.zeros(int(inverse.max(initial=-1)) + 1, np.int64)
    np.add.at(total, inverse, counts)
    total = total[inverse]
    ends = np.cumsum(n)
    return _rows([(b, s, None, _squeeze(total[e - k : e])) for b, s, k, e in zip(t["bucket"].to_pylist(), t["shard"].to_pylist(), n, ends.tolist())])


def document_scores(g: Grams, total: np.ndarray, n_words: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document, the sum of log10 S over its words and how many words were met in their full context."""
    words = len(g.doc)
    here = [np.zeros(words, np.int64) for _ in range(order)]
    for k in range(order):
        own = g.index[k] * len(g.n) + g.doc[g.exists[k]]
        _, back, count = np.unique(own, return_inverse=True, return_counts=True)
        here[k][g.exists[k]] = total[g.index[k]] - count[back]
    rest = np.maximum(n_words - g.n[g.doc], 0)
    out = np.where(here[0] > 0, np.log10(np.maximum(here[0], 1)) - np.log10(np.maximum(rest, 1)), -np.log10(rest + 1.0))
    full = np.zeros(words, bool)
    for k in range(1, order):
        # The context of the k+1-gram that ends at i is the k-gram that ends at i - 1.
        context = np.concatenate((np.zeros(1, np.int64), here[k - 1][:-1])) if words else here[k - 1]
        hit = g.exists[k] & (here[k] > 0)
        longer = np.log10(np.maximum(here[k], 1)) - np.log10(np.maximum(context, 1))
        out = np.where(hit, longer, np.where(g.exists[k], out + np.log10(BACKOFF), out))
        full = hit
    sums = np.bincount(g.doc, out, len(g.n))
    return sums, np.bincount(g.doc, full, len(g.n)).astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, full_context, log10_sum, log10_mean for every row of ``docs``."""
    shards = n_shards_for(text_bytes(docs), SHARD_BYTES)
    buckets = max(1, -(-shards // 2))
    texts = sharded(docs, shards)
    # Within a bucket the remainder of all values is the same, so what is sent is the quotient.
    packed = lambda v: pack_sorted(v // np.uint64(buckets))

    def send(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        g, shard = Grams(t, order), t["shard"][0].as_py()
        rows = [(b, shard, packed(g.distinct[k]), _squeeze(g.count[k])) for b, k in g.by_bucket(buckets) if len(k) and b]
        first = next(k for b, k in g.by_bucket(buckets) if b == 0)
        rows.append((0, shard, packed(np.concatenate(([TOTAL], g.distinct[first]))), _squeeze(np.concatenate(([len(g.doc)], g.count[first])))))
        return _rows(rows)

    def score(t: pa.Table, told: pa.Table) -> pa.Table:
        g = Grams(t, order)
        blobs = dict(zip(told["bucket"].to_pylist(), told["b"].to_pylist()))
        total, n_words = np.zeros(len(g.distinct), np.int64), 0
        for b, k in g.by_bucket(buckets):
            if b == 0:
                found = _unsqueeze(blobs[0], len(k) + 1)
                n_words, total[k] = int(found[0]), found[1:]
            elif len(k):
                total[k] = _unsqueeze(blobs[b], len(k))
        sums, full = document_scores(g, total, n_words, order)
        mean = np.where(g.n > 0, sums / np.maximum(g.n, 1), 0.0)
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "n_words": g.n, "full_context": full, "log10_sum": sums, "log10_mean": mean})

    counts = texts.groupBy("shard").applyInArrow(releasing(send), SENT).groupBy("bucket").applyInArrow(releasing(_sum_counts), SENT)
    return texts.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(releasing(score), "doc_id long, n_words long, full_context long, log10_sum double, log10_mean double")
