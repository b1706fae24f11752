import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from coverlace.llm import dedup, suffix
from coverlace.llm.suffix import plcp_at_least, suffix_array
from tests.llm import brute


@pytest.mark.parametrize("short", [0, suffix.SHORT])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256))])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 200, 3000])
def test_suffix_array_equals_sorting(alphabet, n, short, monkeypatch):
    monkeypatch.setattr(suffix, "SHORT", short)
    rng = random.Random(n * 7 + len(alphabet))
    s = bytes(rng.choice(alphabet) for _ in range(n))
    s += s[: n // 2] * 2
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_large_alphabet_of_names_recurses(monkeypatch):
    monkeypatch.setattr(suffix, "SHORT", 0)
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(9)) for _ in range(3000)]
    s = b"".join(rng.choice(words) for _ in range(9000))
    sa = suffix_array(s)
    assert np.array_equal(np.sort(sa), np.arange(len(s)))
    assert all(s[sa[i] : sa[i] + 400] <= s[sa[i + 1] : sa[i + 1] + 400] for i in range(0, len(s) - 1, 3))


def test_permuted_prefixes():
    s = b"x" + b"abcdefghijklmnop" + b"yy" + b"abcdefghijklmnop" + b"z"
    sa = suffix_array(s)
    hit = plcp_at_least(np.frombuffer(s, np.uint8), sa, 12)
    before = dict(zip(sa[1:].tolist(), sa[:-1].tolist()))
    for i in range(len(s)):
        j = before.get(i)
        assert hit[i] == (j is not None and len(s[i : i + 12]) == 12 and s[i : i + 12] == s[j : j + 12])


def test_a_value_of_many_shards_goes_by_whole_runs():
    """What counts is the runs that a bucket gets: one in each of 2,000 shards, as at 6 GB, is nothing to cut."""
    value = dedup.pack6(np.array([7, 8, 9], np.uint64))
    few, many, one = [1, 1, 1], [1, 20, 1], dedup._bits(np.zeros(3, bool))

    def marks(numbers):
        rows = [(0, i, 0, value, one, np.array(numbers, "<u4").tobytes()) for i in range(2000)]
        t = dedup._answer_values(dedup._rows(rows)).to_pylist()
        assert len({(r["a"], r["b"]) for r in t}) == 1
        return dedup._unbits(t[0]["a"], 3).tolist(), dedup._unbits(t[0]["b"], 3).tolist()

    assert marks(few) == ([True] * 3, [False] * 3)
    assert marks(many) == ([True, False, True], [False, True, False])
    assert marks([1, 200, 1]) == ([True] * 3, [False, True, False])


@pytest.mark.parametrize(("many", "very_many"), [(1 << 15, 1 << 17), (10, 40), (0, 1 << 17), (0, 0)])
def test_repeats_of_frequent_values_equal_brute_force(many, very_many, monkeypatch):
    """All steps without Spark: whole runs, runs cut by longer grams, single starts, and all of them beside each other."""
    monkeypatch.setattr(dedup, "MANY", many)
    monkeypatch.setattr(dedup, "VERY_MANY", very_many)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
    line = lambda k: " ".join(word() for _ in range(k))
    notice, passage = line(16), line(60)
    rows = [(i, f"{line(rng.randrange(1, 30))} {notice} {line(rng.randrange(1, 30))}") for i in range(60)]
    rows += [(100 + i, f"{line(3)} {passage[i : 200 - i]} {line(4)}") for i in range(8)]
    rows += [(200, "a" * 700), (201, "b" + "a" * 300), (202, "ab " * 300), (203, None), (204, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    buckets = 3
    tables = [pa.table({"shard": pa.array([k] * len(own), pa.int32()), "doc_id": pa.array([i for i, _ in own], pa.int64()), "text": pa.array([x for _, x in own], pa.string())}) for k in range(4) for own in [rows[k::4]]]

    def dealt(sent, by):
        t = pa.concat_tables(sent)
        return {k: t.filter(pa.compute.equal(t[by], k)) for k in sorted(set(t[by].to_pylist()))}

    told = dealt([dedup._answer_values(x) for x in dealt([dedup._send_values(buckets)(t) for t in tables], "bucket").values()], "shard")
    answers = dealt([dedup._answer_strings(x) for x in dealt([dedup._send_strings(buckets)(t, told[k]) for k, t in enumerate(tables)], "bucket").values()], "shard")
    expected = {(i, b): g for (i, _), (b, g) in zip(rows, brute.removed(rows))}
    assert sum(g.sum() for g in expected.values()) > 3000
    for k, t in enumerate(tables):
        s = dedup.Shard(t, buckets)
        gone, at = dedup._marked(s, answers[k], buckets), 0
        for i, data in zip(s.ids, s.datas):
            assert (gone[at : at + len(data)] == expected[i, data]).all()
            at += len(data)


def test_cut_runs_are_fewer_than_starts_and_hold_them_all():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    s = dedup.Shard(pa.table({"shard": [0], "doc_id": [1], "text": [text]}), 2)
    cut = dedup._cut(s, np.arange(len(s.value)))
    for r, pieces in cut.items():
        assert [o for o, _, _ in pieces] == np.cumsum([0] + [m for _, m, _ in pieces])[:-1].tolist()
        assert sum(m for _, m, _ in pieces) == s.count[r]
    starts = int(s.count.sum())
    assert starts == 60_000 - 49
    assert sum(map(len, cut.values())) < starts / 3
