"""Class-conditional Kneser-Ney models of toxic and ordinary documents.

A word's count in a class is the number of that class's different documents that hold it (a continuation count: the
contexts it is met in). Counts are discounted, and the mass that the discount frees backs off to the word's beginning,
counted the same way in the class, and from there to the shared counts of both classes: a rare word is likely in a class
if words that begin like it are, and rare beginnings have the same likelihood ratio in whichever class they were met. A document's
score compares the two models word by word: the logarithm of the mean, over its words, of the toxic by the ordinary
likelihood, which does not depend on length. A logistic curve, fitted on labelled rows that are scored without their own
counts, makes it a probability.

Cases: a null text counts as empty; a text without words has a ratio of one; labels that are null are left out; several
labels of one id count as toxic if one is; labelled rows with equal texts count once; without labelled rows of both
classes every score is 0; an empty table gives an empty result; other columns are ignored, labels, languages, sources
and ids are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlace.llm.common import releasing_batches

#: Labelled rows that the models are fitted on at most, those with the least hash of their id.
MAX_LABELLED = 20_000
#: The rows of each of so many parts are scored by counts of the others; those scores fit the logistic curve.
PARTS = 5
#: Characters of a word's beginning, and the mark before beginnings in tables of counts.
STEM_CHARACTERS, STEM = 4, "\0"
THRESHOLD = 0.7

_words = re.compile(r"[^\W_]+").findall


class Model:
    """Likelihood ratios of words, of beginnings for other words, of all the rest, and the logistic curve."""

    def __init__(self, ratios: dict[str, float], rare: float, slope: float = 0.0, shift: float = -math.inf):
        self.ratios, self.rare, self.slope, self.shift = ratios, rare, slope, shift

    def ratio(self, text: str | None) -> float:
        words = _words((text or "").lower())
        if not words:
            return 0.0
        get, rare = self.ratios.get, self.rare
        found = list(map(get, words))
        if None in found:
            found = [get(STEM + w[:STEM_CHARACTERS], rare) if r is None else r for w, r in zip(words, found)]
        return math.log(sum(found) / len(words))

    def score(self, ratio: np.ndarray) -> np.ndarray:
        if self.shift == -math.inf:
            return np.zeros(len(ratio))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * ratio + self.shift, -60, 60)))


def _curve(ratio: np.ndarray, toxic: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton's method; the slope is held back where classes separate."""
    x, beta = np.stack([ratio, np.ones(len(ratio))], 1), np.zeros(2)
    hold = np.diag([ridge, 1e-6])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (p - toxic) + hold @ beta)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def discount(toxic_documents: float) -> float:
    """What is taken off every count: chance pairs of a word and a class grow with the square root of the documents."""
    return 0.75 + 0.1 * math.sqrt(toxic_documents)


def class_model(words: list[str], c: np.ndarray, n: np.ndarray, documents: float) -> Model:
    """Ratios from counts ``c`` (a row a word or marked beginning, a column a class) and the counts' sums ``n`` (a row
    for words, a row for beginnings)."""
    d = discount(documents)
    taken, shared = np.maximum(c - d, 0), c.sum(axis=1, keepdims=True)
    is_stem = np.fromiter((w[0] == STEM for w in words), bool, len(words))
    # What is not in ``words`` is in too few documents of either class to be more than the discount.
    free = np.stack([1 - taken[~is_stem].sum(axis=0) / n[0], 1 - taken[is_stem].sum(axis=0) / n[1]])
    lift = taken[is_stem] / n[1] / np.maximum(shared[is_stem] / n[1].sum(), 1e-12) + free[1]
    taken_stems = taken[is_stem]
    stems = {w: k for k, w in enumerate(w for w, s in zip(words, is_stem) if s)}
    rest = free[1]
    base = np.array([lift[stems[x]] if (x := STEM + w[:STEM_CHARACTERS]) in stems else rest for w, s in zip(words, is_stem) if not s]).reshape(-1, 2)
    p = taken[~is_stem] / n[0] + free[0] * base * shared[~is_stem] / n[0].sum()
    own = taken[~is_stem].any(axis=1)
    ratios = dict(zip([w for w, k in zip((w for w, s in zip(words, is_stem) if not s), own) if k], (p[own, 1] / p[own, 0]).tolist()))
    odds = float(free[0, 1] / free[0, 0])
    ratios |= {w: float(lift[k, 1] / lift[k, 0]) * odds for w, k in stems.items() if taken_stems[k].any()}
    return Model(ratios, odds * float(rest[1] / rest[0]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) names."""
    spark = docs.sparkSession
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Bounded by MAX_LABELLED rows, so it may be broadcast.
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")).persist()
    columns = [f"c{toxic}_{part}" for part in range(PARTS) for toxic in (0, 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter() for _ in columns]
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part"))):
                own = set(_words(text.lower()))
                found[2 * part + int(toxic > 0)].update(own | {STEM + w[:STEM_CHARACTERS] for w in own})
            words = list(set().union(*found))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)], names=["word", *columns])

    try:
        held = [F.count_if((F.col("part") == part) & ((F.col("toxic") > 0) == bool(toxic))).alias(f"c{toxic}_{part}") for part in range(PARTS) for toxic in (0, 1)]
        documents = np.array(rows.agg(*held).first(), float).reshape(PARTS, 2)
        if not documents.sum(axis=0).all():
            return Model({}, 1.0)
        counts = rows.mapInArrow(releasing_batches(count), "word string, " + ", ".join(f"{c} long" for c in columns)).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).persist()
        kind = F.startswith("word", F.lit(STEM))
        sums = {r[0]: np.array(r[1:], float).reshape(PARTS, 2) for r in counts.groupBy(kind).agg(*[F.sum(c) for c in columns]).collect()}
        sums = np.stack([sums.get(k, np.zeros((PARTS, 2))) for k in (False, True)])
        # All that the discount leaves in any of the models; bounded by the labelled sample.
        least = discount((documents[:, 1].sum() - documents[:, 1]).min())
        of = lambda toxic: sum(F.col(f"c{toxic}_{part}") for part in range(PARTS))
        table = counts.where((of(0) > least) | (of(1) > least)).orderBy("word").toPandas()
        counts.unpersist()
        words, c = table["word"].tolist(), table[columns].to_numpy(float).reshape(-1, PARTS, 2)
        model = class_model(words, c.sum(axis=1), np.maximum(sums.sum(axis=1), 1), documents[:, 1].sum())
        others = [class_model(words, c.sum(axis=1) - c[:, k], np.maximum(sums.sum(axis=1) - sums[:, k], 1), documents[:, 1].sum() - documents[k, 1]) for k in range(PARTS)]
        told = spark.sparkContext.broadcast(others)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ratios = [told.value[k].ratio(x) for x, k in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(ratios, pa.float64()), batch.column("toxic")], names=["ratio", "toxic"])

        # Two numbers for each of at most MAX_LABELLED rows.
        measured = rows.select("text", "part", "toxic").mapInArrow(releasing_batches(measure), "ratio double, toxic int").toPandas()
        model.slope, model.shift = _curve(measured["ratio"].to_numpy(), (measured["toxic"] > 0).to_numpy(float))
        told.unpersist()
        return model
    finally:
        rows.unpersist()


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those of ids whose CRC-32 modulo 3 is not 1."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1).select("doc_id", "toxic")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` that are doc_id and text, and the score."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = told.value.score(np.array([told.value.ratio(x) for x in batch.column(1).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(releasing_batches(run), "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, training_labels(labels))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = told.value.score(np.array([told.value.ratio(x) for x in batch.column("text").to_pylist()], float))
            yield batch.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(releasing_batches(run), docs.schema)
