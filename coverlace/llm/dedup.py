"""Repeated passages removed by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Equal strings
are brought together first: the least hash of the short grams within a string (a winnowed value) depends on the string
alone, so equal strings have equal values. A document is a sequence of runs of string starts with one value. Five steps
over shards of documents and buckets of values, all in one plan (the shuffled texts are reused):

1. each shard sends its distinct values to their buckets;
2. each bucket answers which values stand in two documents or more, and which have many runs or very many;
3. each shard sends the runs with such values, as one string each (identical strings once, with the least id); runs of a
   value that has many are cut where the value of longer grams changes and go by that, and runs of a value that has very
   many are sent start by start, by the hash of the string itself, so that no bucket gets a frequent value whole;
4. each bucket joins identical strings, sorts the suffixes of the others by induced sorting, and finds by permuted
   common prefixes which starts share ``length`` bytes; it answers for each start whether a smaller id has it;
5. each shard marks what the starts cover and digests or cuts its documents.

Cases: a null text counts as empty; texts under ``length`` bytes stay whole; very long texts are read block by block and
their runs go to buckets like all others; rows with one id never remove from each other; a null doc_id counts as greater than all others (and stays null); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coverlace.llm.common import n_shards_for, pack6, releasing, sharded, text_bytes, unpack6
from coverlace.llm.suffix import plcp_at_least, suffix_array

LENGTH = 50
#: Bytes of the grams whose least hash is a string's value.
GRAM = 20
#: The same for runs of a value that has many: longer grams part what shares a short one.
FINE = 40
#: Text bytes of one shard, about.
SHARD_BYTES = 4 << 20
#: Bytes hashed at a time.
BLOCK = 1 << 18
#: Starts of one run at most (longer runs, as in periodic text, are several).
RUN = 128
#: A value with more runs in all shards is cut by longer grams; one with more than the second, start by start. Runs, not
#: shards, are what a bucket has to bear: numbers of shards would make ever more values hot as the input grows.
MANY, VERY_MANY = 1 << 15, 1 << 17
#: Bytes that are sorted in one suffix array, about.
SORT_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max

_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_POWER = {n: np.uint64(pow(_FACTOR, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32)}
_S32, _MIX = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position."""
    part, width, h, done = _TABLE[raw], 1, None, 0
    while True:
        if gram & width:
            if h is None:
                h = part
            else:
                n = len(raw) - done - width + 1
                h = h[:n] * _POWER[width] + part[done : done + n]
            done += width
        if done == gram:
            break
        part = part[:-width] * _POWER[width] + part[width:]
        width *= 2
    h ^= h >> _S32
    h *= _MIX
    h ^= h >> _S32
    return h


def string_values(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Least hash of the grams within the LENGTH bytes from each position, its upper 48 bits."""
    h = gram_hashes(raw, gram)
    span = LENGTH - gram + 1
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        n = len(raw) - LENGTH + 1
        h = np.minimum(h[:n], h[span - width : span - width + n])
    return h >> np.uint64(16)


def runs(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, number of starts, value) of all runs, in order."""
    out, block, room = [], [], BLOCK

    def flush() -> None:
        doc, base, pieces = zip(*block)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.cumsum(size) - size
        v = string_values(raw)
        cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
        stops = at + size - LENGTH + 1
        points = np.unique(np.concatenate((cuts, at, stops)))
        begin, end = points[:-1], points[1:]
        piece = np.searchsorted(at, begin, side="right") - 1
        real = begin < stops[piece]
        begin, end, piece = begin[real], end[real], piece[real]
        if (parts := -(-(end - begin) // RUN)).max(initial=1) > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, end, piece = np.repeat(begin, parts) + nth * RUN, np.repeat(end, parts), np.repeat(piece, parts)
            end = np.minimum(end, begin + RUN)
        out.append((np.array(doc)[piece], begin - at[piece] + np.array(base)[piece], end - begin, v[begin]))
        block.clear()

    for d, data in enumerate(datas):
        if len(data) < LENGTH:
            continue
        for base in range(0, len(data) - LENGTH + 1, BLOCK):
            piece = data[base : base + BLOCK + LENGTH - 1] if len(data) > BLOCK else data
            block.append((d, base, piece))
            room -= len(piece)
            if room <= 0:
                flush()
                room = BLOCK
    if block:
        flush()
    if not out:
        return tuple(np.zeros(0, np.uint64 if i == 3 else np.int64) for i in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


class Shard:
    """A shard's documents in a fixed order, with their runs and the distinct values by bucket."""

    def __init__(self, table: pa.Table, buckets: int):
        ids = table["doc_id"].to_pylist()
        datas = [b"" if x is None else x for x in table["text"].cast(pa.large_binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, datas[i]))
        self.order = order
        self.ids = [ids[i] for i in order]
        self.datas = [datas[i] for i in order]
        self.rank = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.doc, self.start, self.count, self.value = runs(self.datas)
        self.distinct, self.inverse = np.unique(self.value, return_inverse=True)
        self.bucket = (self.distinct % np.uint64(buckets)).astype(np.int64)
        self.by_bucket = np.argsort(self.bucket, kind="stable")
        self.bounds = np.searchsorted(self.bucket[self.by_bucket], np.arange(buckets + 1))

    def buckets(self):
        """(bucket, positions of its values in ``distinct``), the non-empty ones."""
        for b in np.flatnonzero(self.bounds[1:] > self.bounds[:-1]).tolist():
            yield b, self.by_bucket[self.bounds[b] : self.bounds[b + 1]]


SENT = "bucket int, shard int, kind int, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "shard", "kind", "a", "b", "c"])


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _send_values(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        s = Shard(t, buckets)
        # Runs are in the order of the documents, so a value's runs of one document stand together.
        order = np.argsort(s.inverse, kind="stable")
        value, doc = s.inverse[order], s.doc[order]
        new = np.concatenate((np.ones(min(len(doc), 1), bool), (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        documents = np.bincount(value[new], minlength=len(s.distinct))
        number = np.bincount(value, minlength=len(s.distinct)).astype("<u4")
        # Documents of one id count as one here only if they are one row; a false candidate costs work, not exactness.
        shard = t["shard"][0].as_py()
        return _rows([(b, shard, 0, pack6(s.distinct[k]), _bits(documents[k] > 1), number[k].tobytes()) for b, k in s.buckets()])

    return run


def _answer_values(t: pa.Table) -> pa.Table:
    blobs = [unpack6(x) for x in t["a"].to_pylist()]
    n = [len(x) for x in blobs]
    multi = np.concatenate([_unbits(x, k) for x, k in zip(t["b"].to_pylist(), n)])
    number = np.concatenate([np.frombuffer(x, "<u4") for x in t["c"].to_pylist()])
    _, inverse, shards = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    shared = (shards > 1) | (np.bincount(inverse, multi) > 0)
    load = np.bincount(inverse, number)
    # Of two marks, the first alone says whole runs, the second alone cut runs, both say start by start.
    hot = shared & (load > MANY)
    shared &= ~hot | (load > VERY_MANY)
    shared, hot = shared[inverse], hot[inverse]
    ends = np.cumsum(n)
    return _rows([(b, s, 1, _bits(shared[e - k : e]), _bits(hot[e - k : e]), None) for b, s, k, e in zip(t["bucket"].to_pylist(), t["shard"].to_pylist(), n, ends.tolist())])


def _wanted(s: Shard, answers: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The two marks of the shard's runs."""
    shared, hot = np.zeros(len(s.distinct), bool), np.zeros(len(s.distinct), bool)
    told = {b: (x, y) for b, x, y in answers}
    for b, k in s.buckets():
        x, y = told[b]
        shared[k], hot[k] = _unbits(x, len(k)), _unbits(y, len(k))
    return shared[s.inverse], hot[s.inverse]


def _cut(s: Shard, pick: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each of these runs, (offset, starts, value) of its pieces whose starts have one value of FINE bytes."""
    out: dict[int, list[tuple[int, int, int]]] = {r: [] for r in pick.tolist()}
    size = s.count[pick] + LENGTH - 1
    for own in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1) if len(pick) else []:
        p = pick[own]
        raw = np.frombuffer(b"".join([s.datas[d][a : a + n] for d, a, n in zip(s.doc[p].tolist(), s.start[p].tolist(), size[own].tolist())]), np.uint8)
        v = string_values(raw, FINE)
        n = s.count[p]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        v = v[np.repeat(np.cumsum(size[own]) - size[own], n) + nth]
        begin = np.flatnonzero((nth == 0) | np.concatenate(([True], v[1:] != v[:-1])))
        for r, o, m, x in zip(np.repeat(p, n)[begin].tolist(), nth[begin].tolist(), np.diff(np.append(begin, len(v))).tolist(), v[begin].tolist()):
            out[r].append((o, m, x))
    return out


def _strings(s: Shard, shared: np.ndarray, hot: np.ndarray, buckets: int):
    """The strings to send, each once: lists by bucket of strings, least ids, and (run, first start) pairs to strings."""
    from xxhash import xxh64_intdigest

    seen: dict[bytes, int] = {}
    strings: list[bytes] = []
    least: list[int] = []
    bucket: list[int] = []
    string_of, run_of, offset_of = [], [], []
    cut = _cut(s, np.flatnonzero(hot & ~shared))
    pick = np.flatnonzero(shared | hot)
    for r, d, a, n, v, h in zip(pick.tolist(), s.doc[pick].tolist(), s.start[pick].tolist(), s.count[pick].tolist(), s.value[pick].tolist(), hot[pick].tolist()):
        data = s.datas[d]
        for o, m, x in (cut[r] if r in cut else [(o, 1, None) for o in range(n)]) if h else ((0, n, v),):
            text = data[a + o : a + o + m + LENGTH - 1]
            k = seen.get(text)
            if k is None:
                k = seen[text] = len(strings)
                strings.append(text)
                least.append(s.rank[d])
                bucket.append((xxh64_intdigest(text) if x is None else x) % buckets)
            string_of.append(k)
            run_of.append(r)
            offset_of.append(o)
    return strings, np.array(least, np.int64), np.array(bucket, np.int64), np.array(string_of, np.int64), np.array(run_of, np.int64), np.array(offset_of, np.int64)


def _send_strings(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows or not told.num_rows:
            return _rows([])
        s, shard = Shard(t, buckets), t["shard"][0].as_py()
        answers = list(zip(told["bucket"].to_pylist(), told["a"].to_pylist(), told["b"].to_pylist()))
        shared, hot = _wanted(s, answers)
        strings, least, bucket, *_ = _strings(s, shared, hot, buckets)
        rows = []
        order = np.argsort(bucket, kind="stable")
        for k in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            own = [strings[i] for i in k.tolist()]
            text = pa.compress(b"".join(own), codec="zstd", asbytes=True) if own else b""
            size = np.fromiter(map(len, own), np.uint16, len(own))
            rows.append((int(bucket[k[0]]), shard, 2, text, size.tobytes(), least[k].astype("<i8").tobytes()))
        # What the shard needs again in the last step takes the way over the buckets.
        mark = pa.compress(_bits(shared) + _bits(hot), codec="zstd", asbytes=True)
        rows.append((shard % buckets, shard, 3, mark, None, None))
        return _rows(rows)

    return run


def earlier_starts(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct string and each of its starts, the least id of all strings that hold these LENGTH bytes; where the
    strings' starts begin in this, and their numbers."""
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    starts = size - LENGTH + 1
    out = np.repeat(least, starts)
    first = np.cumsum(starts) - starts
    heads = np.frombuffer(b"".join([x[:LENGTH] for x in strings]), np.uint8)
    value = np.concatenate([string_values(heads[i : i + LENGTH * 4096])[::LENGTH] for i in range(0, len(heads), LENGTH * 4096)]) if n else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1], [True]))) if n else np.zeros(1, np.int64)
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    # A value with one string has nothing to be sorted against; distinct strings of LENGTH bytes share no start.
    alone = (np.diff(edge) == 1) | (np.maximum.reduceat(size[order], edge[:-1]) == LENGTH if n else np.zeros(0, bool))
    keep = order[~alone[group]]
    kept_group = group[~alone[group]]
    if len(keep):
        total = np.cumsum(size[keep] + 1)
        shard = total // SORT_BYTES
        shard = shard[np.searchsorted(kept_group, kept_group)]  # a value's strings stay together
        for own in np.split(keep, np.flatnonzero(np.diff(shard)) + 1):
            raw = np.frombuffer(b"\xff".join([strings[i] for i in own.tolist()]), np.uint8)
            sa = suffix_array(raw)
            with_previous = plcp_at_least(raw, sa, LENGTH)
            at = np.cumsum(size[own] + 1) - size[own] - 1
            place = np.full(len(raw), -1, np.int64)
            flat = np.repeat(at - (np.cumsum(starts[own]) - starts[own]), starts[own]) + np.arange(starts[own].sum())
            place[flat] = np.repeat(first[own] - (np.cumsum(starts[own]) - starts[own]), starts[own]) + np.arange(starts[own].sum())
            sa = sa[place[sa] >= 0]
            heads_of = np.flatnonzero(~with_previous[sa])
            found = np.minimum.reduceat(out[place[sa]], heads_of)
            out[place[sa]] = np.repeat(found, np.diff(np.append(heads_of, len(sa))))
    return out, first, starts


def _answer_strings(t: pa.Table) -> pa.Table:
    rows, told = [], []
    seen: dict[bytes, int] = {}
    strings: list[bytes] = []
    least: list[int] = []
    for bucket, shard, kind, a, b, c in zip(*(t[x].to_pylist() for x in ("bucket", "shard", "kind", "a", "b", "c"))):
        if kind == 3:
            rows.append((bucket, shard, 3, a, None, None))
            continue
        size, ids = np.frombuffer(b, "<u2"), np.frombuffer(c, "<i8")
        text = pa.decompress(a, decompressed_size=int(size.sum(dtype=np.int64)), codec="zstd", asbytes=True)
        own, at = [], 0
        for n, i in zip(size.tolist(), ids.tolist()):
            s = text[at : at + n]
            at += n
            k = seen.get(s)
            if k is None:
                k = seen[s] = len(strings)
                strings.append(s)
                least.append(i)
            elif i < least[k]:
                least[k] = i
            own.append(k)
        told.append((bucket, shard, np.array(own, np.int64), ids))
    by_start, first, starts = earlier_starts(strings, np.array(least, np.int64))
    for bucket, shard, own, ids in told:
        m = starts[own]
        bits = by_start[np.repeat(first[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())] < np.repeat(ids, m)
        rows.append((bucket, shard, 4, pa.compress(_bits(bits), codec="zstd", asbytes=True), None, None))
    return _rows(rows)


def _marked(s: Shard, told: pa.Table, buckets: int) -> np.ndarray:
    """Over the shard's concatenated bytes, what is to be removed."""
    sizes = np.fromiter(map(len, s.datas), np.int64, len(s.datas))
    at = np.cumsum(sizes) - sizes
    gone = np.zeros(int(sizes.sum()), bool)
    kinds = told["kind"].to_pylist()
    if 3 not in kinds:
        return gone
    blobs = told["a"].to_pylist()
    n = len(s.value)
    half = -(-n // 8)
    mark = pa.decompress(blobs[kinds.index(3)], decompressed_size=2 * half, codec="zstd", asbytes=True)
    shared, hot = _unbits(mark[:half], n), _unbits(mark[half:], n)
    strings, least, bucket, string_of, run_of, offset_of = _strings(s, shared, hot, buckets)
    starts = np.fromiter((len(x) - LENGTH + 1 for x in strings), np.int64, len(strings))
    answer = np.zeros(int(starts.sum()), bool)
    first = np.cumsum(starts) - starts
    told_of = {b: x for b, k, x in zip(told["bucket"].to_pylist(), kinds, blobs) if k == 4}
    order = np.argsort(bucket, kind="stable")
    for k in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        m = int(starts[k].sum())
        bits = _unbits(pa.decompress(told_of[int(bucket[k[0]])], decompressed_size=-(-m // 8), codec="zstd", asbytes=True), m)
        answer[np.repeat(first[k] - (np.cumsum(starts[k]) - starts[k]), starts[k]) + np.arange(m)] = bits
    # One entry per run and string: all starts of the string, from the run's start plus the offset.
    count = starts[string_of]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = s.doc[run_of]
    position = np.repeat(at[doc] + s.start[run_of] + offset_of, count) + nth
    # A greater id than the shard's least with this string goes whatever the other shards hold.
    flag = answer[np.repeat(first[string_of], count) + nth] | np.repeat(s.rank[doc] > least[string_of], count)
    begin = np.zeros(len(gone) + 1, bool)
    begin[position[flag]] = True
    seen = np.cumsum(begin[:-1], dtype=np.int32)
    gone[:] = seen > 0
    gone[LENGTH:] = seen[LENGTH:] > seen[:-LENGTH]
    return gone


def _finish(docs: DataFrame, schema, of: Callable[[pa.Table, Shard, np.ndarray], pa.Table], carry: list[str] | None = None) -> DataFrame:
    shards = n_shards_for(text_bytes(docs), SHARD_BYTES)
    buckets = max(1, -(-shards // 4))
    texts = sharded(docs, shards, carry)
    plain = texts.select("shard", "doc_id", "text") if carry else texts
    values = plain.groupBy("shard").applyInArrow(releasing(_send_values(buckets)), SENT)
    shared = values.groupBy("bucket").applyInArrow(releasing(_answer_values), SENT)
    strings = plain.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(releasing(_send_strings(buckets)), SENT)
    answers = strings.groupBy("bucket").applyInArrow(releasing(_answer_strings), SENT)

    def last(t: pa.Table, told: pa.Table) -> pa.Table:
        s = Shard(t, buckets)
        return of(t, s, _marked(s, told, buckets))

    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(releasing(last), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""

    def of(_: pa.Table, s: Shard, gone: np.ndarray) -> pa.Table:
        removed, spans, sha, at = [], [], [], 0
        for data in s.datas:
            g = gone[at : at + len(data)]
            at += len(data)
            k = int(np.count_nonzero(g))
            removed.append(k)
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if k else 0)
            sha.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~g].tobytes() if k else data).hexdigest())
        return pa.table({"doc_id": pa.array(s.ids, pa.int64()), "n_bytes": pa.array([len(x) for x in s.datas], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _finish(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", of)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of the texts (the bytes of a cut character left out) and n_chars to match.

    Cases as above; all rows stay, also those of which nothing is left; other columns stay whatever their names are, and
    all columns keep their types.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def of(t: pa.Table, s: Shard, gone: np.ndarray) -> pa.Table:
        texts, at = [], 0
        for data in s.datas:
            g = gone[at : at + len(data)]
            at += len(data)
            texts.append((np.frombuffer(data, np.uint8)[~g].tobytes() if g.any() else data).decode("utf-8", "ignore"))
        rows = t.take(pa.array(s.order, pa.int64()))
        carried = rows["carried"].combine_chunks() if others else None
        cols = {"doc_id": rows["doc_id"], "text": pa.array(texts, pa.string())}
        for k, c in enumerate(others):
            cols[c] = carried.field(k)
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(x) for x in texts], pa.int64())
        return pa.table([cols[c] for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    schema = StructType([StructField(f.name, LongType() if f.name in ("doc_id", "n_chars") else f.dataType) for f in docs.schema.fields])
    out = _finish(docs, schema, of, others)
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in ("doc_id", "n_chars") else F.col(f"`{f.name}`") for f in docs.schema.fields])
