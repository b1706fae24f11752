"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlace.llm import audio, bpe, dedup, extract, lm, minhash, oracles, packing, simhash, toxicity, urls
from coverlace.llm.common import documents, pages


def tokenizer(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


#: (verdict, host, beginning of the path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(pages(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir), order=3)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.verdicts(pages(spark, sf_dir), URL_RULES)
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tunes rendered from the whole table of embeddings, queries every row whose id is divisible by 20."""
    return audio.searches(audio.rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.digests(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir), words=3, errors=3)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), *tokenizer("byte_bpe_multi_50k.tiktoken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), *tokenizer("byte_bpe_50k.json"), width=1024)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_extract, op2_lm_scores, op3_suffix_dedup, op4_url_filters, op5_simhash, op6_bpe, op7_chroma, op8_toxicity, op9_packing, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    """The others have tokenizers, models, fingerprints or parsers that SQL lacks; tests/llm hold them against plain
    versions."""
    return {"op4_url_filters": oracles.url_filters(URL_RULES)}
