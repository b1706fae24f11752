"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are made per document; equal ones collapse before anything is joined. Two fingerprints within ``errors``
bits agree on one of ``errors + 1`` blocks, so every fingerprint enters one trie per block, keyed by that block's bits
and holding the rest. A trie is a sorted array; a node is a range of it. Pairs of nodes are walked together from the
root, one bit a step: a pair's differing bits add up and the pair is dropped as soon as they exceed the budget. Tries
that hold very many fingerprints are dealt out by pairs of nodes some bits below the root, as many as their size asks for,
so no task gets a hot key whole. Each trie gives a spanning forest of its links, and the forests meet in star contractions.

Cases: a null text counts as empty; no words give fingerprint zero, linked like any other; fewer words than a shingle
are one shingle; very long texts are counted piece by piece; repeated rows share their fingerprint and class; a null doc_id never is a class's least id unless no
other is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlace.llm.common import releasing, releasing_batches, text_list
from coverlace.operators.components import connected_components
from coverlace.session import materialize

#: Fingerprints in one trie beyond which it is dealt out by node pairs.
HOT_TRIE = 200_000
#: Bits below the root at which a hot trie is dealt out, at most.
MAX_SPLIT = 12
#: Fingerprints that one task's tries hold, about.
TASK_ROWS = 400_000


def shingles(data: bytes, k: int) -> list[bytes]:
    """k-word shingles of ASCII-lower-cased bytes, repeats included; fewer words: one shingle; none: none."""
    words = data.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, k: int) -> int:
    from xxhash import xxh64_intdigest

    s = shingles(data, k)
    return majority(np.fromiter((xxh64_intdigest(x, 42) for x in s), np.uint64, len(s)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in text_list(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(releasing_batches(run), "doc_id long, fp long")


# The trie join -------------------------------------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Union-find over 0..n-1 for arrays of links; keeps the links that joined two components, which span them."""

    def __init__(self, n: int):
        self.label, self.version, self.used = np.arange(n), 0, []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            self.version += 1
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((lo, hi))
            top = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]
            label[hi[top]] = lo[top]
            self.used.append(np.stack([a[top], b[top]], 1))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.concatenate([np.zeros((0, 2), np.int64), *self.used])
        return used[:, 0], used[:, 1]


def _children(keys: np.ndarray, pairs: np.ndarray, same: np.ndarray, level: int, errors: int) -> np.ndarray:
    """The pairs of nodes a bit below ``pairs`` that are within the budget."""
    a0, a1, b0, b1, used = pairs.T
    bit, one = np.uint64(63 - level), np.uint64(1)

    def middle(lo, hi):
        first = ((keys[lo] >> bit >> one << one) | one) << bit
        return np.clip(np.searchsorted(keys, first), lo, hi)

    am, bm = middle(a0, a1), middle(b0, b1)
    kids = [
        np.stack([a0, am, b0, bm, used], 1),
        np.stack([am, a1, bm, b1, used], 1),
        np.stack([a0, am, bm, b1, used + 1], 1),
        np.stack([am, a1, b0, bm, used + 1], 1)[~same],
    ]
    kids = np.concatenate(kids)
    kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= errors)]
    return kids[~((kids[:, 0] == kids[:, 2]) & (kids[:, 1] - kids[:, 0] == 1))]


def walk(keys: np.ndarray, roots: np.ndarray, top: int, errors: int, forest: Forest, chunk: int = 1 << 13) -> None:
    """Link in ``forest`` all keys within ``errors`` bits of each other below the same root.

    ``keys`` are sorted 64-bit; ``roots`` holds rows (a0, a1, b0, b1, bits used up); ``top`` is the number of leading
    bits that the walk has passed. A few pairs at a time are followed to the leaves, and pairs of nodes whose keys are
    all in one component already are not followed, so a family of close keys costs little more than its members.
    """
    stack = [(roots.astype(np.int64), top)]
    near = np.flatnonzero(popcount(keys[1:] ^ keys[:-1]) <= errors)
    forest.link(near, near + 1)
    version, changes = -1, np.zeros(0, np.int64)
    while stack:
        pairs, level = stack.pop()
        if len(pairs) > chunk:
            stack += [(pairs[i : i + chunk], level) for i in range(0, len(pairs), chunk)]
            continue
        if version != forest.version:
            changes = np.concatenate(([0], np.cumsum(forest.label[1:] != forest.label[:-1])))
            version = forest.version
        a0, a1, b0, b1, _ = pairs.T
        joined = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (forest.label[a0] == forest.label[b0])
        pairs = pairs[~joined]
        if not len(pairs):
            continue
        a0, a1, b0, b1, used = pairs.T
        same = a0 == b0
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        ends = single & ~same
        if ends.any():
            i, j = a0[ends], b0[ends]
            near = popcount(keys[i] ^ keys[j]) <= errors
            forest.link(i[near], j[near])
        go = ~single
        if level >= 64:  # both nodes are one key each, or one key repeated
            continue
        pairs, same = pairs[go], same[go]
        if not len(pairs):
            continue
        kids = _children(keys, pairs, same, level, errors)
        if len(kids):
            stack.append((kids, level + 1))


def bordering(keys: np.ndarray, groups: np.ndarray, roots: np.ndarray, top: int, errors: int, chunk: int = 1 << 13) -> np.ndarray:
    """Marks of the sorted ``keys`` that have another within ``errors`` bits below the same root in a different one of
    ``groups``; a negative group differs from every other and is marked as it is. Pairs of nodes inside one group, or
    whose keys are all marked, are passed over, so close families cost little more than their members."""
    stack = [(roots.astype(np.int64), top)]
    changes = np.concatenate(([0], np.cumsum((groups[1:] != groups[:-1]) | (groups[1:] < 0))))
    marks, stale, open_ = groups < 0, True, np.zeros(0, np.int64)

    def mark(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal stale
        near = (popcount(keys[i] ^ keys[j]) <= errors) & ((groups[i] != groups[j]) | (groups[i] < 0))
        both = np.concatenate((i[near], j[near]))
        stale |= not marks[both].all()
        marks[both] = True

    beside = np.arange(max(0, len(keys) - 1))
    mark(beside, beside + 1)
    while stack:
        pairs, level = stack.pop()
        if len(pairs) > chunk:
            stack += [(pairs[i : i + chunk], level) for i in range(0, len(pairs), chunk)]
            continue
        if stale:
            open_, stale = np.concatenate(([0], np.cumsum(~marks))), False
        a0, a1, b0, b1, _ = pairs.T
        done = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (groups[a0] == groups[b0]) & (groups[a0] >= 0)
        done |= (open_[a1] == open_[a0]) & (open_[b1] == open_[b0])
        single, same = (a1 - a0 == 1) & (b1 - b0 == 1), a0 == b0
        ends = single & ~same & ~done
        mark(a0[ends], b0[ends])
        go = ~single & ~done
        pairs, same = pairs[go], same[go]
        if level >= 64 or not len(pairs):
            continue
        kids = _children(keys, pairs, same, level, errors)
        if len(kids):
            stack.append((kids, level + 1))
    return marks


def _rotated(fp: np.ndarray, shift: np.ndarray) -> np.ndarray:
    s = shift.astype(np.uint64)
    return np.where(s == 0, fp, (fp << s) | (fp >> (np.uint64(64) - np.where(s == 0, np.uint64(1), s))))


def trie_links(keys: np.ndarray, roots: np.ndarray, level: int, errors: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between sorted ``keys`` below ``roots`` that span their components, as two arrays of keys; with ``groups``,
    the keys that have a link to a different group, twice."""
    if groups is not None:
        marked = keys[bordering(keys, groups, roots, level, errors)]
        return marked, marked
    forest = Forest(len(keys))
    walk(keys, roots, level, errors, forest)
    i, j = forest.links()
    return keys[i], keys[j]


def _unique(keys: np.ndarray, groups: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    keys, first = np.unique(keys, return_index=True)
    return keys, None if groups is None else groups[first]


def whole_tries(keys: np.ndarray, width: int, errors: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within each trie of ``keys`` that agree on their first ``width`` bits."""
    keys, groups = _unique(keys, groups)
    head = keys >> np.uint64(64 - width)
    starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    stops = np.append(starts[1:], len(keys))
    roots = np.stack([starts, stops, starts, stops, np.zeros_like(starts)], 1)[stops - starts > 1]
    return trie_links(keys, roots, width, errors, groups)


def flips(bits: int, errors: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``errors`` ones."""
    return [m for m in range(1 << bits) if m.bit_count() <= errors]


def dealt_tries(keys: np.ndarray, p: np.ndarray, q: np.ndarray, bits: int, width: int, errors: int, groups: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between pairs of nodes (p, q) that stand ``bits`` below the roots of hot tries."""
    out, split, mask = [], np.uint64(bits), np.uint64((1 << bits) - 1)
    tag = (keys >> np.uint64(64 - width)) << (split + split) | p.astype(np.uint64) << split | q.astype(np.uint64)
    for t in np.unique(tag):
        own, of = _unique(keys[tag == t], None if groups is None else groups[tag == t])
        node = own >> np.uint64(64 - width - bits) & mask
        a, b, n = int(t >> split & mask), int(t & mask), len(own)
        cut = 0 if a == b else int(np.searchsorted(node, np.uint64(b)))
        root = [0, n, 0, n, 0] if a == b else [0, cut, cut, n, (a ^ b).bit_count()]
        if root[0] < root[1] and root[2] < root[3]:
            out.append(trie_links(own, np.array([root]), width + bits, errors, of))
    return out


def links(prints: DataFrame, errors: int = 3) -> DataFrame:
    """(tab, a, b): links whose components are those of all pairs of ``prints`` (tab, fp; distinct rows) of one table
    within ``errors`` bits.

    Where ``prints`` has a column grp, the prints that have another of a different grp within ``errors`` bits instead, as
    a and as b; a null grp differs from every other.
    """
    spark = prints.sparkSession
    blocks, width = errors + 1, 64 // (errors + 1)
    n = prints.count()
    turned = lambda b: F.shiftleft("fp", b * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - b * width)) if b else F.col("fp")
    grouped = "grp" in prints.columns
    extra = [F.coalesce("grp", F.lit(-1)).cast("long").alias("grp")] if grouped else []
    each = prints.select("tab", *extra, F.explode(F.array(*[F.struct(F.lit(b).alias("block"), turned(b).alias("key")) for b in range(blocks)])).alias("x"))
    extra = ["grp"] if grouped else []
    each = each.select("tab", *extra, F.col("x.block").alias("block"), F.col("x.key").alias("key"), F.shiftrightunsigned("x.key", 64 - width).alias("head"))
    node_at = lambda bits: F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - width) - bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    # A trie is dealt out as far as its number of keys asks for, if they were even, and all the way where they are not. At
    # most tables * blocks * 2**width heads exist, so the broadcast tables are bounded whatever the input.
    by_count = F.least(F.lit(MAX_SPLIT), F.ceil(F.log2(2 * F.col("count") / HOT_TRIE)).cast("int"))
    hot = each.groupBy("tab", "block", "head").count().where(F.col("count") > HOT_TRIE).select("tab", "block", "head", by_count.alias("bits"))
    nodes = each.join(F.broadcast(hot), ["tab", "block", "head"]).groupBy("tab", "block", "head", "bits", node_at(F.col("bits")).alias("node")).count()
    hot = nodes.groupBy("tab", "block", "head").agg(F.when(F.max("count") > HOT_TRIE, MAX_SPLIT).otherwise(F.first("bits")).alias("bits"))
    masks = F.array(*[F.array(*[F.lit(m) for m in flips(b, errors)]) for b in range(1, MAX_SPLIT + 1)])
    dealt = each.join(F.broadcast(hot), ["tab", "block", "head"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    dealt = dealt.withColumn("node", node_at(F.col("bits")))
    near = F.transform(F.element_at(masks, F.col("bits")), lambda m: m.bitwiseXOR(F.col("node")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("bits") > 0, near).otherwise(F.array(F.lit(-1)))))
    lo = F.when(F.col("other") < 0, -1).otherwise(F.least("node", "other"))
    hi = F.when(F.col("other") < 0, -1).otherwise(F.greatest("node", "other"))
    tasks = max(1, -(-n * blocks // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select("tab", "block", "key", *extra, "bits", lo.alias("lo"), hi.alias("hi"), F.pmod(F.xxhash64("tab", "block", "head", lo, hi), F.lit(tasks)).cast("int").alias("task"))

    def run(t: pa.Table) -> pa.Table:
        kind, keys = t["tab"].to_numpy().astype(np.int64) * blocks + t["block"].to_numpy(), t["key"].to_numpy().view(np.uint64)
        p, q, bits = t["lo"].to_numpy(), t["hi"].to_numpy(), t["bits"].to_numpy()
        groups = t["grp"].to_numpy() if grouped else None
        found = []
        for k in np.unique(kind):
            back = np.full(1, (64 - (k % blocks) * width) % 64)
            for b in np.unique(bits[kind == k]).tolist():
                pick = (kind == k) & (bits == b)
                own = groups[pick] if grouped else None
                pairs = dealt_tries(keys[pick], p[pick], q[pick], b, width, errors, own) if b else [whole_tries(keys[pick], width, errors, own)]
                for x, y in pairs:
                    found.append((k // blocks, _rotated(x, back), _rotated(y, back)))
        none = [np.zeros(0, np.uint64)]
        tab = np.concatenate([np.full(len(x), k) for k, x, _ in found] or [np.zeros(0)]).astype(np.int32)
        a, b = (np.concatenate([f[c] for f in found] or none).view(np.int64) for c in (1, 2))
        return pa.table({"tab": tab, "a": a, "b": b})

    return dealt.groupBy("task").applyInArrow(releasing(run), "tab int, a long, b long")


def classes(docs: DataFrame, words: int = 3, errors: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links of ``errors`` bits."""
    prints = materialize(fingerprints(docs, words), "simhash")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    comps = connected_components(links(least.select(F.lit(0).alias("tab"), "fp"), errors), "a", "b")
    placed = least.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.join(ids, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(by_fp, "fp").select("doc_id", hexed, "component_id")


# Near copies by shared shingles --------------------------------------------------------------------------------------

#: Independent fingerprints of a document's set of words. Few changed words leave most tables within three bits.
TABLES = 8
#: Parts of the counts by which unlike texts are told apart without loss.
PROFILE = 64
#: Cells in which shingles are counted to put the rare ones first. The order decides costs, not results, so the size is
#: fixed; the counts (8 MB) are sent to all tasks.
CELLS = 1 << 20
#: Texts under one shingle that are paired in one block, about.
BLOCK = 256
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def word_set_fingerprints(data: bytes, tables: int = TABLES) -> list[int]:
    """SimHashes of the set of words, one per table, as signed longs."""
    from xxhash import xxh64_intdigest

    words = set(data.lower().split())
    h = np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    out = np.zeros(tables, np.uint64)
    for k in range(tables):
        g = h * np.uint64(_ODD * (2 * k + 1) % (1 << 64))
        g = (g ^ (g >> np.uint64(29))) * _MIX
        out[k] = majority(g ^ (g >> np.uint64(32)))
    return out.view(np.int64).tolist()


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """Ascending 32-bit hashes of the set of k-word shingles. A shingle of one text meets another one of a text of n by
    chance in n of 4 billion cases, which stands for the same shingle."""
    from xxhash import xxh64_intdigest

    s = set(shingles(data, k))
    return np.unique(np.fromiter((xxh64_intdigest(x, 7) >> 32 for x in s), np.uint32, len(s)))


def profile(hashes: np.ndarray) -> bytes:
    """How many shingles fall in each of PROFILE parts: two sets differ in at least the sum of the counts' differences."""
    return np.bincount(hashes % PROFILE, minlength=PROFILE).astype("<u4").tobytes()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets, each ascending without repeats; 1 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def prefixes(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, rarest first, of which any set as ``similarity`` and of as many shingles or more has
    one among its own; and how many of them are enough on the smaller set's side."""
    n = len(hashes)
    order = np.lexsort((hashes, counts[hashes % CELLS]))
    all_of = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return hashes[order[:all_of]], min(n, n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)) + 1)


def _plausible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b; nodes) that the counts of shingles by parts do not tell apart; none that are
    ``similarity`` alike is lost."""
    most = (1 - similarity) / (1 + similarity) + 1e-9
    of = lambda c: texts.select(F.col("node").alias(c), F.col("profile").alias(f"profile_{c}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, PROFILE).astype(np.int64) for c in ("profile_a", "profile_b"))
            fit = np.abs(x - y).sum(axis=1) <= most * (x.sum(axis=1) + y.sum(axis=1))
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "profile_a", "profile_b").mapInArrow(releasing_batches(near), "a long, b long")


def _raw() -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def _sets(nodes: DataFrame, texts: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the shingles of ``nodes`` (node; distinct), read again from one row of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, words).astype("<u4").tobytes() for t in text_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    wanted = texts.join(nodes, "node", "left_semi").select("node", F.col("raw").alias("of"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), _raw().alias("of"), "text")
    found = own.join(wanted, ["of", "id", "no_id"]).select("node", "text").mapInArrow(releasing_batches(run), "node long, hashes binary")
    return materialize(found.dropDuplicates(["node"]), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b; nodes) whose sets of shingles are ``similarity`` alike."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [jaccard(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) >= similarity for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(releasing_batches(compare), "a long, b long")


def _components(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``texts`` with the least node of each one's component."""
    comps = connected_components(edges, "a", "b").withColumnRenamed("node", "of")
    return texts.join(comps, F.col("node") == F.col("of"), "left").drop("of").withColumn("component", F.coalesce("component", "node"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, errors: int = 3) -> DataFrame:
    """(raw, kept_id, component, kept): one row per different sequence of words, with the digest and the id of its row
    with the least id, the number of its component, and whether it is the one that its component keeps.

    Texts of equal words (in the sense of ``shingles``) are one from the start. Candidates are all pairs within ``errors``
    bits in the tries of a table, and a candidate counts if the shingles of both texts are ``similarity`` alike. First a
    spanning forest of each table's candidates is compared. Texts that are still within ``errors`` bits of one in another
    component are then compared with each other where they share one of the rarest shingles that alike sets must share
    and their counts of shingles do not tell them apart, so no candidate goes unanswered and a family of close but unlike
    texts does not make all its pairs.

    Cases: a null text counts as empty, and all texts without words are alike; texts of fewer words than a shingle are one
    shingle; of ties the least digest stands first; a null doc_id is kept only where a component has no other; repeated
    rows are one text; an empty table gives an empty result; other columns are ignored.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch.column("text"))
            cols = [[hashlib.sha256(t).digest()[:16] for t in texts], [hashlib.sha256(b" ".join(t.lower().split())).digest()[:16] for t in texts]]
            cols = [pa.array(c, pa.binary()) for c in cols] + [pa.array([word_set_fingerprints(t) for t in texts], pa.list_(pa.int64())), pa.array([profile(shingle_hashes(t, words)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=["doc_id", "raw", "digest", "fps", "profile"])

    rows = docs.select("doc_id", "text").mapInArrow(releasing_batches(run), "doc_id long, raw binary, digest binary, fps array<long>, profile binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "raw")).alias("k")
    texts = rows.groupBy("digest").agg(first, F.first("fps").alias("fps"), F.first("profile").alias("profile"))
    # The numbers are fixed once the table is written.
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("node"), "k.doc_id", "k.raw", "fps", "profile"), "texts")
    entries = texts.select("node", F.posexplode("fps").alias("tab", "fp"))
    least = materialize(entries.groupBy("tab", "fp").agg(F.min("node").alias("rep")), "classes")
    same = entries.join(least, ["tab", "fp"]).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    of = lambda c: least.select("tab", F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    across = links(least.select("tab", "fp"), errors).join(of("a"), ["tab", "a"]).join(of("b"), ["tab", "b"]).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    pairs = materialize(_plausible(_ordered(same.unionByName(across)), texts, similarity), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first_edges = materialize(_alike(pairs, _sets(ends, texts, docs, words), similarity), "alike")
    placed = materialize(_components(texts, first_edges), "placed")
    left = _borders(placed, errors)
    edges = first_edges.unionByName(_rare_partners(left, _sets(left.select("node"), texts, docs, words), similarity))
    placed = _components(texts, edges).select("node", "doc_id", "raw", "component")
    kept = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "raw", "node")).alias("k"))
    return placed.join(kept, "component").select("raw", "component", F.col("doc_id").alias("kept_id"), (F.col("node") == F.col("k.node")).alias("kept"))


def _borders(placed: DataFrame, errors: int) -> DataFrame:
    """(node, grp): the texts of ``placed`` (node, fps, component) that are within ``errors`` bits of one of another
    component in some table."""
    entries = placed.select("node", F.col("component").alias("grp"), F.posexplode("fps").alias("tab", "fp"))
    grouped = entries.groupBy("tab", "fp").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    grouped = materialize(grouped.select("tab", "fp", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("grp")), "groups")
    marked = links(grouped, errors).select("tab", F.col("a").alias("fp")).unionByName(grouped.where("grp is null").select("tab", "fp")).distinct()
    nodes = entries.join(marked, ["tab", "fp"], "left_semi").select("node").distinct()
    return materialize(placed.join(nodes, "node", "left_semi").select("node", F.col("component").alias("grp")), "borders")


def _rare_partners(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of ``nodes`` (node, grp) of different groups whose ``sets`` are ``similarity`` alike."""
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<u4")
            total += np.bincount(hashes % CELLS, minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    # At most CELLS rows, whatever the input.
    counted = sets.select("hashes").mapInArrow(releasing_batches(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    told = spark.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, grp, blob in zip(*(batch.column(c).to_pylist() for c in ("node", "grp", "hashes"))):
                hashes = np.frombuffer(blob, "<u4")
                own, few = prefixes(hashes, told.value, similarity)
                k = len(own)
                out.append((own.astype(np.int64), np.full(k, node), np.full(k, grp), np.full(k, len(hashes)), np.arange(k), np.arange(k) < few, np.tile(np.frombuffer(profile(hashes), "<u4").astype(np.int32), k)))
            if out:
                *cols, parts = (np.concatenate(c) for c in zip(*out))
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) + 1, PROFILE, dtype=np.int32)), pa.array(parts))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), parts], names=["h", "node", "grp", "n", "pos", "few", "parts"])

    own = sets.join(nodes, "node").mapInArrow(releasing_batches(rare), "h long, node long, grp long, n long, pos long, few boolean, parts array<int>")
    own = materialize(own, "rare")
    sizes = own.groupBy("h").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo < hi").select("h", "blocks")
    placed = own.join(sizes, "h")
    a = placed.where("few").select("h", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias(f"{c}_a") for c in ("node", "grp", "n", "pos", "parts")])
    b = placed.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_b") for c in ("node", "grp", "n", "pos", "parts")])
    # The smaller set's few rarest shingles meet the larger one's; what stands behind them bounds what both can share.
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    within = (F.struct("n_a", "node_a") < F.struct("n_b", "node_b")) & (F.col("grp_a") != F.col("grp_b")) & (F.col("n_a") >= similarity * F.col("n_b") - 1e-9)
    within &= F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= needed
    on = (a["h"] == b["h"]) & (a["block"] == b["block"])
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    within &= apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-9
    pairs = _ordered(a.join(b, on & within).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return materialize(_alike(materialize(pairs, "partners"), sets, similarity), "alike")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least doc_id, of equal ones any.

    Cases as in ``near_copies``; repeated rows stay once, other columns stay whatever their names are.
    """
    kept = near_copies(docs.select("doc_id", "text"), words, similarity).where("kept")
    # Under names that no column of the table has.
    taken = {c.lower() for c in docs.columns}
    raw, id_, null, nth = (next(f"{c}{k}" for k in range(len(taken) + 1) if f"{c}{k}" not in taken) for c in ("raw", "id", "null", "nth"))
    kept = kept.select(F.col("raw").alias(raw), F.coalesce("kept_id", F.lit(0)).alias(id_), F.col("kept_id").isNull().alias(null))
    named = docs.select("*", _raw().alias(raw), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(null))
    found = named.join(kept, [raw, id_, null], "left_semi")
    once = found.withColumn(nth, F.row_number().over(Window.partitionBy(raw, id_, null).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
