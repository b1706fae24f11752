"""Corpus operators against plain versions: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlace.llm import audio, bpe, dedup, lm, minhash, packing, simhash, toxicity, urls
from coverlace.llm.queries import URL_RULES, oracle_sql, queries, tokenizer
from tests.llm import brute

SCHEMA = "doc_id long, text string, shard int, bucket string, n_chars long"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéö") for _ in range(rng.randrange(1, 8)))
    line = lambda k: " ".join(word() for _ in range(k))
    passage = line(30)
    rows = [(i, line(rng.randrange(1, 80))) for i in range(n)]
    rows += [(100 + i, f"{line(3)} {passage} {line(4)}") for i in range(12)]
    rows += [(200 + i, rows[5][1]) for i in range(4)]
    base = line(120).split(" ")
    rows += [(300 + i, " ".join(base[:i] + ["zz"] + base[i + 1 :])) for i in range(0, 60, 9)]
    rows += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "It's  a   test\n\n x  y"), (405, "a" * 3000), (406, "ab " * 4000), (3, rows[3][1]), (None, rows[7][1]), (None, None)]
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x", len(t or "")) for i, t in rows], SCHEMA).repartition(parts)


def order(rows):
    return sorted(rows, key=repr)


def rows_of(df):
    return order([tuple(r) for r in df.collect()])


EMPTY = []


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 20])
def test_suffix_dedup(spark, rows, monkeypatch, shard_bytes):
    monkeypatch.setattr(dedup, "SHARD_BYTES", shard_bytes)
    got = rows_of(dedup.digests(table(spark, rows)))
    assert got == order([brute.removal_row(i, b, g) for (i, _), (b, g) in zip(rows, brute.removed(rows))])


def test_frequent_values_are_sent_start_by_start(rows):
    """The path of values that stand in very many documents, without Spark."""
    import pyarrow as pa

    t = pa.table({"shard": [0] * len(rows), "doc_id": [i for i, _ in rows], "text": [x for _, x in rows]})
    s = dedup.Shard(t, 4)
    everything = np.ones(len(s.value), bool)
    for hot in (~everything, everything):
        strings, least, bucket, *_ = dedup._strings(s, everything, hot, 4)
        sent = [(int(b), 0, 2, pa.compress(b"".join(own), codec="zstd", asbytes=True), np.array([len(x) for x in own], "<u2").tobytes(), least[k].astype("<i8").tobytes()) for b in np.unique(bucket) for k in [np.flatnonzero(bucket == b)] for own in [[strings[i] for i in k]]]
        n = len(s.value)
        sent.append((0, 0, 3, pa.compress(dedup._bits(everything) + dedup._bits(hot), codec="zstd", asbytes=True), None, None))
        answers = [dedup._answer_strings(dedup._rows([r for r in sent if r[0] == b])) for b in sorted({r[0] for r in sent})]
        gone = dedup._marked(s, pa.concat_tables(answers), 4)
        expected = {(i, b): g for (i, _), (b, g) in zip(rows, brute.removed(rows))}
        at = 0
        for i, data in zip(s.ids, s.datas):
            assert (gone[at : at + len(data)] == expected[i, data]).all()
            at += len(data)
        assert n == len(everything)


def test_without_repeats_keeps_columns(spark, rows):
    out = dedup.without_repeats(table(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    got = order([(r.doc_id, r.text, r.n_chars, r.shard, r.bucket) for r in out.collect()])
    text = [np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for b, g in brute.removed(rows)]
    assert got == order([(i, t, len(t), 7, "x") for (i, _), t in zip(rows, text)])


def test_simhash_classes(spark, rows):
    got = rows_of(simhash.classes(table(spark, rows)))
    assert got == order(brute.classes(rows))


def test_near_copies_leave_one_of_each_group(spark, rows):
    kept = simhash.without_near_copies(table(spark, rows)).collect()
    ids = [r.doc_id for r in kept]
    assert sum(i is not None and 300 <= i < 400 for i in ids) == 1 and 5 in ids and not {200, 201, 202, 203} & set(ids)
    assert ids.count(3) == 1 and {1, 2, 403, 405, 406} <= set(ids)
    assert set(kept[0].asDict()) == {"doc_id", "text", "shard", "bucket", "n_chars"}


def test_lm_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 4000)
    got = order([(r.doc_id, r.n_words, round(r.log10_sum, 6)) for r in lm.scores(table(spark, rows)).collect()])
    assert got == order([(i, n, round(float(s), 6) + 0.0) for i, n, s in brute.backoff(rows)])


def test_bpe_equals_the_library(spark, rows):
    import base64

    import tiktoken

    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = [*rows, (500, "naïve café — “quoted” 12345678 ½ ² x_y\x1c\x85z 日本語 🙂🙂 <|endoftext|>"), (501, "x" * 200 + "é" * 90), (502, "don't I'll we've'd  \u00a0  end ")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in more for ids in [e.encode_ordinary(t or "")]]
    assert rows_of(bpe.digests(table(spark, more), path, pattern)) == order(expected)
    back = bpe.decode_column(bpe.encode_column(table(spark, more), path, pattern), path)
    assert order([(r.doc_id, r.text) for r in back.collect()]) == order([(i, t or "") for i, t in more])


def test_plain_texts_are_split_alike():
    import regex

    from coverlace.llm import pieces

    _, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    full, split = regex.compile(pattern).findall, pieces.splitter(pattern)
    rng = random.Random(12)
    letters = [chr(c) for c in range(1, 0x250)] + ["'s", "'ll", "'re", "'x", "  ", "\n\n", " '", "_"] * 20
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        t = t if rng.random() < 0.3 else pieces.OTHER.sub("", t)
        assert split(t) == full(t)
    assert all(split(c) == full(c) for c in map(chr, range(1, 0x3000)))


def test_bpe_one_at_a_time_equals_in_step():
    path, _ = tokenizer("byte_bpe_50k.json")
    v = bpe.vocabulary(path)
    rng = random.Random(4)
    words = [bytes(rng.choice(b"aeiou nth\xc3\xa9") for _ in range(rng.randrange(1, 64))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_many(words)] == [v.encode_one(w) for w in words]


@pytest.mark.parametrize("width", [16, 1024])
def test_packing(spark, rows, width):
    from tokenizers import Tokenizer

    path, pattern = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    distinct = [(k, x) for k, (_, x) in enumerate([*rows, (1, "a <|endoftext|> b")])]
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x in distinct}
    got = packing.pack(table(spark, distinct), path, pattern, width).collect()
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n == width or n < width and n & (n - 1) == 0 for n in filled.values())
    assert sorted(filled) == list(range(len(filled)))


def test_minhash(spark, rows):
    got = minhash.edited_fingerprints(table(spark, rows)).collect()
    assert len(got) == len(rows)
    places = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    by_text = {}
    for r in got:
        texts = [t for i, t in places if i == r.doc_id and len(t) == r.n_chars]
        assert texts and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts) == 1:
            assert by_text.setdefault(texts[0], r.fingerprint) == r.fingerprint
            k = places.index((r.doc_id, texts[0]))
            same_id = sum(i == r.doc_id for i, _ in places) == 1
            if same_id and k + 1 < len(places) and sum(i == places[k + 1][0] for i, _ in places) == 1:
                n, nxt = r.n_chars, places[k + 1][1]
                assert r.edited_sha256 == hashlib.sha256((texts[0][: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()


def plain_minhash(text):
    """One-permutation MinHash with densification, hash by hash."""
    import struct

    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def fold(values, kind="<q"):
        seed = 42
        for v in values:
            seed = xxh64_intdigest(struct.pack(kind, v), seed)
        return signed(seed)

    words = [signed(xxh64_intdigest(w.encode(), 42)) for w in (text or "").lower().split()]
    hashes = [fold(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    least = {}
    for h in hashes:
        b = (h & (1 << 64) - 1) >> 57
        least[b] = min(least.get(b, h), h)
    if not least:
        return ""

    def drawn(e):
        return min((signed((fold((e, b), "<i") & (1 << 64) - 256) | h & 255) for b, h in least.items())) & 255

    return "".join(f"{least[e] & 255 if e in least else drawn(e):02x}" for e in range(128))


def test_minhash_equals_a_plain_version(spark, rows):
    got = {r.doc_id: (r.fingerprint, r.near_next) for r in minhash.edited_fingerprints(table(spark, rows)).collect()}
    text = dict(rows)
    once = [i for i in text if i is not None and sum(j == i for j, _ in rows) == 1]
    assert {i: got[i][0] for i in once} == {i: plain_minhash(text[i]) for i in once}
    # near_next: the share of equal bytes, without those that agree by chance.
    follow = {a: b for a, b in zip(sorted(once, reverse=True), sorted(once, reverse=True)[1:])}
    for i, j in list(follow.items())[:40]:
        if 3 in (i, j):
            continue
        a, b = (bytes.fromhex(plain_minhash(text[x])) for x in (i, j))
        same = sum(x == y for x, y in zip(a, b)) / 128
        expected = (1.0 if not a and not b else 0.0) if not a or not b else max(0.0, (same - 1 / 256) / (1 - 1 / 256))
        if not any(i > k > j for k, _ in rows if k is not None):
            assert got[i][1] == pytest.approx(expected)


def test_minhash_likeness_is_near_the_truth(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(150):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 500))]
        cut = rng.randrange(len(a))
        pairs.append((" ".join(a), " ".join(a[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(len(a) - cut)])))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", minhash.likeness(minhash.fingerprint_bytes(F.col("a")), minhash.fingerprint_bytes(F.col("b"))).alias("j")).collect()
    s = lambda x: {tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)}
    errors = np.array([r.j - len(s(r.a) & s(r.b)) / len(s(r.a) | s(r.b)) for r in got])
    assert abs(errors.mean()) < 0.015 and (errors**2).mean() ** 0.5 < 0.06


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    bad = ["vile", "awful", "nasty"]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            text += rng.sample(bad, 2)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs += [(None, None), (601, ""), (602, "vile awful nasty"), (603, "w1 w2 w3 w4 w5 w6"), (0, docs[0][1])]
    labels += [(602, None), (None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.predictions(table(spark, docs), lab).collect()
    assert len(got) == len(docs)
    score = {r.doc_id: r.score for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [(score[i], y) for i, y in labels[:600] if zlib.crc32(str(i).encode()) % 3 == 1]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97 and score[602] > 0.7 > score[603]
    none = toxicity.predictions(table(spark, docs), lab.where("toxic = 0")).collect()
    assert all(r.score == 0 for r in none)


def pagerank(edges, seeds, rounds=urls.ROUNDS, damping=urls.DAMPING):
    rank = dict(seeds)
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    for _ in range(rounds):
        new = {}
        for (a, b), n in edges.items():
            if a in rank:
                new[b] = new.get(b, 0) + damping * rank[a] * n / out[a]
        lost = 1 - sum(new.values())
        for h, m in seeds.items():
            new[h] = new.get(h, 0) + m * lost
        rank = new
    return rank


def test_toxicity_keeps_rare_expressions_beside_many_words(spark):
    ordinary = [" ".join(f"w{(i % 20) * 6000 + j}" for j in range(6000)) + f" own{i}" for i in range(60)]
    toxic = [f"rareslur t{i}" for i in range(2)] + [f"u{i} v{i}" for i in range(8)]
    docs = table(spark, list(enumerate(ordinary + toxic)))
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(72)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    words = {w for w in model.ratios if not w.startswith(toxicity.STEM)}
    assert "rareslur" in words and len(words) > 100_000


def test_url_filters(spark):
    rng = random.Random(8)
    pages = []
    for k in range(120):
        host = rng.choice(["a.org", "b.com", "example.org", "www.example.org", "c.net", "d.net", "SPAM.net", "com", "xcom"])
        path = rng.choice(["/en/17", "/es/x", "/fr/", "/de/y?q=/fr/", "", "/en/2#f"])
        links = "".join(f'<a href="{rng.choice(["http://", "//", "https://"])}{rng.choice(["a.org", "c.net", "spam.net", "b.com"])}/p">' for _ in range(rng.randrange(3)))
        pages.append((k, f"http://{host}{path}", links))
    pages += [(200, None, None), (201, "no scheme", "<a href=http://a.org>"), (202, "http://", ""), (203, "x://Spam.NET?u", None), (7, *pages[7][1:])]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, trust int").repartition(3)
    got = {(r.page_id, r.host, r.path): r for r in urls.verdicts(df.drop("host", "trust"), URL_RULES).collect()}
    assert len(urls.verdicts(df, URL_RULES).collect()) == len(pages)
    import re

    parsed, edges, good, bad = [], {}, {}, {}
    for k, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fit = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        parsed.append((k, host, path, rule))
        if host:
            for to in {x.split("//")[1].split("/")[0] for x in re.findall(r'href="?((?:http:|https:)?//[^">]+)', html or "")}:
                pass
            for full in set(re.findall(r'href="?((?:https?:)?//[^">]+)', html or "")):
                to = re.match(r"(?:https?:)?//([^/?#]*)", full)[1].lower()
                if to != host:
                    edges[host, to] = edges.get((host, to), 0) + 1
            if rule:
                side = good if rule[0] == "allow" else bad
                side[host] = side.get(host, 0) + 1
    norm = lambda s: {h: n / sum(s.values()) for h, n in s.items()}
    trust, distrust = pagerank(edges, norm(good)), pagerank({(b, a): n for (a, b), n in edges.items()}, norm(bad))
    for k, host, path, rule in parsed:
        r = got[k, host, path]
        assert r.rule == (rule[1] + rule[2] if rule else None)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        assert r.verdict == (rule[0] if rule else "block" if d > t else "allow") or abs(d - t) < 1e-9


def test_chroma(spark):
    rng = np.random.default_rng(3)

    def tune(notes):
        t = np.arange(audio.RATE // 8) / audio.RATE
        return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])

    notes = rng.integers(0, 24, 80)
    other = rng.integers(0, 24, 80)
    whole = tune(notes)
    noise = whole + 0.05 * rng.standard_normal(len(whole))
    late = tune(np.concatenate([rng.integers(0, 24, 16), notes[:60]]))
    as_bytes = lambda x: (x * 8000).astype("<i2").tobytes()
    media = [(0, as_bytes(whole)), (1, as_bytes(noise)), (2, as_bytes(late)), (3, as_bytes(tune(other))), (4, as_bytes(whole)), (5, b""), (6, None), (7, b"\x01"), (20, as_bytes(tune(other)))]
    got = {r.id: r for r in audio.searches(spark.createDataFrame(media, "id long, media binary")).collect()}
    assert len(got) == len(media) and got[4].class_id == 0 and got[20].class_id == 3 and got[5].n_frames == 0
    found = {m.match: m for m in got[0].aligned}
    assert set(found) == {1, 2} and found[1].offset == 0 and abs(found[2].offset - 16 * audio.RATE // 8 / audio.HOP) <= 1
    assert got[1].aligned is None


def test_chroma_links_two_recordings_whatever_their_ids(spark):
    ids = spark.range(1, 20_000).select(F.col("id").alias("x"), F.explode(F.array(F.lit(0).cast("long"), "id")).alias("id"))
    clash = ids.groupBy("x").agg(F.approx_count_distinct("id").alias("n")).where("n = 1 and x % 20 != 0").agg(F.min("x")).first()[0]
    rng = np.random.default_rng(4)
    t = np.arange(audio.RATE // 8) / audio.RATE
    tune = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, 60)])
    as_bytes = lambda x: (x * 8000).astype("<i2").tobytes()
    media = [(0, as_bytes(tune)), (clash, as_bytes(tune + 0.02 * rng.standard_normal(len(tune))))]
    got = {r.id: r for r in audio.searches(spark.createDataFrame(media, "id long, media binary")).collect()}
    assert [m.match for m in got[0].aligned] == [clash]


def test_chroma_votes_of_common_codes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 32, 25)
    rows = [(k, f"d{k}", np.where(np.arange(100) % 4 == 0, np.repeat(common, 4), rng.integers(0, 1 << 32, 100)).tolist()) for k in range(90)]
    noisy = [c if i % 4 == 0 else c ^ 0b1001001 for i, c in enumerate(rows[0][2])]
    rows += [(101, "noisy", noisy), (102, "tone", [7] * 60), (103, "held", [5] * 3 + [7] * 50), (120, "asks", [7] * 40 + [9])]
    monkeypatch.setattr(audio, "QUERY_FRAMES", 200)
    monkeypatch.setattr(audio, "HITS", 500)
    got = {(r["query"], r["match"]): r for r in audio.alignments(spark.createDataFrame(rows, "id long, digest string, codes array<long>")).collect()}
    codes = {i: c for i, _, c in rows}
    for q in (i for i in codes if i % 20 == 0):
        for m in codes:
            votes = Counter(j - i for i, x in enumerate(codes[q]) for j, y in enumerate(codes[m]) if x == y)
            if q == m or not votes:
                continue
            offset = max(votes, key=lambda o: (votes[o], -abs(o), -o))
            both = [(x, codes[m][i + offset]) for i, x in enumerate(codes[q]) if 0 <= i + offset < len(codes[m])]
            error = sum((x ^ y).bit_count() for x, y in both) / (32 * len(both))
            r = got.pop((q, m), None)
            assert (r is not None) == (votes[offset] >= audio.MIN_VOTES and error <= audio.MAX_ERROR)
            assert r is None or (r.offset, r.votes, r.overlap, r.bit_error) == (offset, votes[offset], len(both), pytest.approx(error))
            if (q, m) in ((0, 101), (120, 102)):
                assert r is not None
    assert not got


def test_chroma_fingerprints_equal_plain_ones():
    image = np.random.default_rng(5).random((30, 12))
    bits = lambda v: v ^ v >> 1
    expected = []
    for t in range(len(image) - audio.SPAN + 1):
        code = 0
        for kind, c, classes, frames in audio.FILTERS:
            own = image[t : t + frames, c : c + classes]
            if kind == "time":
                a, b = own[: frames // 2].sum(), own[frames // 2 :].sum()
            elif kind == "class":
                a, b = own[:, : classes // 2].sum(), own[:, classes // 2 :].sum()
            else:
                a = own[frames // 3 : frames - frames // 3].sum()
                b = own.sum() - a
            code = code << 2 | bits(sum(np.log((a + 1e-3) / (b + 1e-3)) > x for x in (-0.15, 0.0, 0.15)))
        expected.append(code)
    assert audio.fingerprint(image).tolist() == expected
    assert len(audio.fingerprint(image[: audio.SPAN - 1])) == 0


def test_chroma_cases(spark):
    rng = np.random.default_rng(6)
    long = (8000 * np.sin(2 * np.pi * 220 * 2 ** (np.repeat(rng.integers(0, 24, 600), audio.RATE // 8) / 12) * np.arange(600 * (audio.RATE // 8)) / audio.RATE)).astype("<i2").tobytes()
    part = long[: len(long) // 3 // 2 * 2]
    rows = [(0, long, "d", 1), (0, long, "d", 1), (7, part, None, None), (None, None, "x", 2), (20, b"", "y", 3)]
    got = audio.searches(spark.createDataFrame(rows, "id long, media binary, digest string, codes int")).collect()
    assert len(got) == 5
    mine = [r for r in got if r.id == 0]
    assert len(mine) == 2 and all([m.match for m in r.aligned] == [7] and r.aligned[0].offset == 0 for r in mine)
    assert next(r for r in got if r.id is None).n_frames == 0 and next(r for r in got if r.id == 20).aligned == []


def test_integral_image_gives_sums():
    image = np.random.default_rng(0).random((20, 12))
    total = audio.integral(image)
    assert total[9, 7] - total[2, 7] - total[9, 3] + total[2, 3] == pytest.approx(image[2:9, 3:7].sum())


def test_empty_tables(spark):
    docs = table(spark, EMPTY)
    path, pattern = tokenizer("byte_bpe_50k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    from coverlace.llm import extract

    for df in (dedup.digests(docs), simhash.classes(docs), lm.scores(docs), packing.pack(docs, path, pattern), minhash.edited_fingerprints(docs), toxicity.predictions(docs, labels), urls.verdicts(pages, URL_RULES), extract.main_texts(pages), bpe.digests(docs, path, pattern), simhash.without_near_copies(docs), dedup.without_repeats(docs), audio.searches(spark.createDataFrame([], "id long, media binary"))):
        assert df.count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(oracle_sql()) <= set(queries())
