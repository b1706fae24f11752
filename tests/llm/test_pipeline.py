"""The pipeline on a small corpus against plain versions of its stages."""

import random

import numpy as np
import pytest

import corpus_pipeline
from coverlace.llm import toxicity
from coverlace.llm.queries import tokenizer
from tests.llm import brute


def corpus():
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "rt", "st", "l", "k")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(60)
    rows = [(i, line(rng.randrange(20, 120))) for i in range(150)]
    for i in range(150, 210):  # toxic ones
        own = line(40).split()
        for k in rng.sample(range(40), 8):
            own[k] = rng.choice(("trashface", "scumbag", "idiotic"))
        rows.append((i, " ".join(own)))
    for i in range(210, 225):  # near copies: a word of a hundred changes
        own = line(100).split()
        rows.append((i, " ".join(own)))
        own = list(own)
        own[rng.randrange(100)] = "changed"
        rows.append((i + 100, " ".join(own)))
    rows += [(400 + i, f"{line(30)} {passage} {line(30)}") for i in range(6)]
    rows += [(500, None), (501, ""), (502, "été ñandú " * 30), (503, rows[2][1]), (504, line(5000)), (None, line(40))]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 210)) for i, _ in rows if i is not None and i < 225], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_equal_plain_ones(spark, folder):
    rows = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    # 1: the model's own scores, text by text.
    kept = stage["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    first = [(i, t) for i, t in rows if model.score(np.array([model.ratio(t)]))[0] < toxicity.THRESHOLD]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, first))
    assert not {i for i, _ in first} & set(range(150, 210)) and len(first) == len(rows) - 60

    # 2: the least id of each component of texts with a five-word Jaccard of 0.8.
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in first]
    label = list(range(len(first)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(first)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union:
                label[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(first):
        root = find(k)
        if root not in best or (i is None, i) < (first[best[root]][0] is None, first[best[root]][0]):
            best[root] = k
    second = sorted((first[k] for k in best.values()), key=repr)
    kept = stage["simhash_near_dedup"](spark, docs.sparkSession.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in first], docs.schema), folder)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == second

    # 3: without every fifty bytes that a smaller id has.
    third = [(i, bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore")) for (i, _), (b, g) in zip(second, brute.removed(second))]
    kept = stage["suffix_array_dedup"](spark, docs.sparkSession.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in second], docs.schema), folder)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=repr) == sorted(((i, t, len(t)) for i, t in third), key=repr)

    # 4 and all together: each text's ids in order, in sequences without gaps.
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")[0])
    tokens = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in third}
    pieces = corpus_pipeline.run(spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(tokens)
    for i, own in by_doc.items():
        own.sort()
        assert [s for s, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1].tolist()] and sum(n for _, n, _ in own) == tokens[i] == own[0][2]
    for own in by_sequence.values():
        own.sort()
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 1024
