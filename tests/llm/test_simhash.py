import random

import numpy as np
import pytest

from coverlace.llm import simhash


def components(keys, errors):
    label = list(range(len(keys)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys[i] ^ keys) <= errors).tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [int(keys[find(i)]) for i in range(len(keys))]


def family(rng, center, n, bits):
    return [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(bits + 1))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_tries_find_all_links(seed):
    rng = random.Random(seed)
    keys = [rng.getrandbits(64) for _ in range(200)]
    for _ in range(5):
        keys += family(rng, rng.getrandbits(64), 60, 5)
    keys = np.unique(np.array([0, *keys], np.uint64))
    forest = simhash.Forest(len(keys))
    for b in range(4):
        turned = simhash._rotated(keys, np.full(1, b * 16))
        for x, y in zip(*simhash.whole_tries(turned, 16, 3)):
            back = simhash._rotated(np.array([x, y]), np.full(1, (64 - b * 16) % 64))
            i, j = np.searchsorted(keys, back)
            forest.link(np.array([i]), np.array([j]))
    assert [int(keys[k]) for k in forest.label] == components(keys, 3)


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_dealt_tries_equal_whole_ones(bits):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    keys = np.unique(np.array(family(rng, center, 400, 6), np.uint64))
    keys = keys[keys >> np.uint64(48) == center >> 48]
    whole, dealt = simhash.Forest(len(keys)), simhash.Forest(len(keys))
    a, b = simhash.whole_tries(keys, 16, 3)
    whole.link(np.searchsorted(keys, a), np.searchsorted(keys, b))
    node = (keys >> np.uint64(48 - bits) & np.uint64((1 << bits) - 1)).astype(np.int64)
    rows = [(k, min(p, p ^ m), max(p, p ^ m)) for k, p in zip(keys.tolist(), node.tolist()) for m in simhash.flips(bits, 3)]
    ks, p, q = (np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
    for a, b in simhash.dealt_tries(ks, p, q, bits, 16, 3):
        dealt.link(np.searchsorted(keys, a), np.searchsorted(keys, b))
    assert whole.label.tolist() == dealt.label.tolist()


@pytest.mark.parametrize("hot", [40, 150, 100_000])
def test_hot_tries_are_dealt_out(spark, monkeypatch, hot):
    rng = random.Random(4)
    keys = [rng.getrandbits(64) for _ in range(100)]
    center = rng.getrandbits(64)
    keys = np.unique(np.array([*keys, *family(rng, center, 500, 5), *family(rng, center ^ 7 << 30, 200, 3)], np.uint64))
    monkeypatch.setattr(simhash, "HOT_TRIE", hot)
    prints = spark.createDataFrame([(0, int(k)) for k in keys.view(np.int64)], "tab int, fp long")
    forest = simhash.Forest(len(keys))
    for r in simhash.links(prints, 3).collect():
        i, j = np.searchsorted(keys, np.array([r.a, r.b], np.int64).view(np.uint64))
        assert int(keys[i] ^ keys[j]).bit_count() <= 3
        forest.link(np.array([i]), np.array([j]))
    assert [int(keys[k]) for k in forest.label] == components(keys, 3)


def test_large_family_stays_cheap():
    rng = random.Random(3)
    keys = np.unique(np.array(family(rng, rng.getrandbits(64), 30_000, 7), np.uint64))
    simhash.whole_tries(keys, 16, 3)


@pytest.mark.parametrize("text", [b"", b"  \n", b"One", b"one two", b"one two three", "Ä b c d".encode()])
def test_shingles(text):
    words = text.lower().split()
    expected = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    assert simhash.shingles(text, 3) == expected


def alike(a, b, words=5):
    x, y = set(simhash.shingles(a.encode(), words)), set(simhash.shingles(b.encode(), words))
    return len(x & y) / len(x | y) if x or y else 1.0


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.without_near_copies(docs).collect())


def least_of_components(texts):
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return sorted({find(i) + 1 for i in range(len(texts))})


def test_jaccard_of_hashes():
    a = " ".join(f"w{i}" for i in range(100))
    b = " ".join(f"w{i}" if i != 50 else "x" for i in range(100))
    assert simhash.jaccard(simhash.shingle_hashes(a.encode(), 5), simhash.shingle_hashes(b.encode(), 5)) == pytest.approx(alike(a, b))
    assert simhash.jaccard(simhash.shingle_hashes(b"", 5), simhash.shingle_hashes(b" ", 5)) == 1.0


def test_near_copies_of_one_word_set_are_compared_with_each_other(spark):
    # Pairs of one word set in another order each: every text is a candidate of every other, only pairs are alike.
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(20):
        own = rng.sample(words, len(words))
        texts += [" ".join(own), " ".join([own[1], own[0], *own[2:]])]
    assert kept(spark, texts) == list(range(1, 41, 2)) == least_of_components(texts)


@pytest.mark.parametrize("seed", range(2))
def test_edited_families_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    rng.shuffle(texts)
    assert kept(spark, texts) == least_of_components(texts)


def test_recall_of_single_pairs(spark):
    # Pairs that have no other near copy, so that a lost pair shows: at least nine of ten are found.
    rng = random.Random(11)
    texts, pairs = [], 0
    while pairs < 300:
        base = [f"p{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300))]
        own = list(base)
        for _ in range(max(1, len(base) // 50)):
            own[rng.randrange(len(own))] = f"p{rng.randrange(4000)}"
        if 0.8 <= alike(" ".join(base), " ".join(own)) <= 0.9:
            texts += [" ".join(base), " ".join(own)]
            pairs += 1
    assert len(kept(spark, texts)) - pairs <= pairs // 10


def test_long_texts_are_decided_on_full_sets(spark):
    texts = []
    for seed in range(3):
        rng = random.Random(seed)
        base = [f"{seed}x{rng.getrandbits(30)}" for _ in range(2000)]
        changed = 42 + seed * 2  # each change of a word takes five shingles of 1,996
        places = range(20, 20 + changed * 40, 40)
        texts += [" ".join(base), " ".join("new" + w if i in places else w for i, w in enumerate(base))]
    assert {alike(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2])} == {True, False}
    assert kept(spark, texts) == least_of_components(texts)


def test_cases_of_near_copies(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(3, words, "x", 1), (3, words, "x", 1), (None, words.upper(), "y", 2), (1, None, "z", 3), (2, " \n", "z", 4), (None, "other", None, None), (7, "other one", "o", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, raw0 string, nth0 int")
    got = simhash.without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "z", 3), (3, words, "x", 1), (7, "other one", "o", 5), (None, "other", None, None)], key=str)
    assert simhash.without_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_keys_beside_another_group(seed):
    rng = random.Random(seed)
    keys = np.unique(np.array([*family(rng, rng.getrandbits(64), 300, 6), *(rng.getrandbits(64) for _ in range(100))], np.uint64))
    groups = np.array([rng.choice((-1, 1, 1, 1, 2)) for _ in keys])
    got = simhash.bordering(keys, groups, np.array([[0, len(keys), 0, len(keys), 0]]), 0, 3)
    near = lambda x, y: int(keys[x] ^ keys[y]).bit_count() <= 3 and groups[x] != groups[y]
    assert got.tolist() == [bool(groups[x] < 0 or any(near(x, y) for y in range(len(keys)))) for x in range(len(keys))]


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 50])
def test_alike_sets_share_one_of_the_rarest(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(simhash.CELLS, np.int64)
    counts[:60] = rng.integers(0, 5, 60)
    for _ in range(200):
        x, y = (np.sort(rng.choice(60, k, replace=False)).astype(np.uint32) for k in (n, min(60, n + int(rng.integers(0, 3)))))
        if rng.random() < 0.7:
            y = np.unique(np.concatenate((x, rng.choice(60, 1).astype(np.uint32))))
        if simhash.jaccard(x, y) >= 0.8:
            (own, few), (other, _) = simhash.prefixes(x, counts, 0.8), simhash.prefixes(y, counts, 0.8)
            assert set(own[:few].tolist()) & set(other.tolist())
