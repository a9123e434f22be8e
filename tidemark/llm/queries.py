"""The thin queries of the numbered operators: whole tables, production parameters, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenstore import digests

    arrow_rows(spark)
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import edited_likeness

    arrow_rows(spark)
    return edited_likeness(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    arrow_rows(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    arrow_rows(spark)
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import deduplicated

    arrow_rows(spark)
    return deduplicated(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    arrow_rows(spark)
    return classify(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target: those that ``labels`` calls good and not toxic."""
    from .lmscore import cross_entropy_difference, marked

    arrow_rows(spark)
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return cross_entropy_difference(marked(table(spark, sf_dir, "documents"), labels), "in_target")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    arrow_rows(spark)
    return main_text(table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    arrow_rows(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_store, op2_quality, op3_embedding_dedup, op4_fingerprints, op5_source_mixing, op6_main_text, op7_bpe, op8_simhash_dedup, op9_suffix_dedup, op10_lm_scores, pipeline)}
ORACLES: dict[str, str] = {}
