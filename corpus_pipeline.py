"""From raw documents to packed sequences: toxic ones out, near copies once, repeated passages once, then packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coverlace.llm import dedup, packing, simhash, toxicity
from coverlace.llm.queries import tokenizer
from coverlace.session import materialize


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not reject as toxic.

    Null and empty texts, and all texts where no label of either class is there, stay; repeated rows share their lot; very
    long texts are scored whole; a score at the threshold is rejected; other columns go through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept(docs, toxicity.fit(docs, toxicity.training_labels(labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike, found by SimHash tries.

    The least id of a group stays (a null one only if there is no other), repeated rows once; texts without words are one
    group; a similarity of 0.8 exactly counts; very long texts are compared whole; other columns go through.
    """
    return simhash.without_near_copies(docs, words=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of fifty bytes that a smaller id has.

    No row goes, also where nothing is left of its text; a null text becomes empty; a null id counts as the greatest; rows of
    one id keep what they share; very long texts are read whole; other columns go through, n_chars follows the text.
    """
    return dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens.

    Null and empty texts are their end mark; a very long text is cut over as many sequences as it needs; repeated rows are
    packed each; other columns are left out.
    """
    return packing.pack(docs, *tokenizer("byte_bpe_50k.json"), width=1024)


STAGES = [("toxicity", keep_ordinary), ("simhash_near_dedup", drop_near_copies), ("suffix_array_dedup", drop_repeats), ("packing", pack)]

#: SQL has neither the models nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
