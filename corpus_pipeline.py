"""Corpus pipeline: language ID, quality, near-duplicates, packing; each stage's result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventimpact.llm import language as languages
from eventimpact.llm import near_texts, packing
from eventimpact.llm import quality as qualities
from eventimpact.llm.common import bounded_batches, fresh, hash_bucket, read, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: texts that are null or without a letter go."""
    bounded_batches(spark)
    lang, sure = fresh(docs, "__lang"), fresh(docs, "__sure")
    model = languages.train(docs.filter(hash_bucket(F.col("doc_id"), 3) != 1))
    return languages.detect(docs, model, lang_out=lang, score_out=sure).filter(F.col(lang) != "und").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on labelled rows, gives a score of at least 0.7 (a null text is an
    empty one)."""
    bounded_batches(spark)
    out = fresh(docs, "__score")
    labels = read(spark, sf_dir, "labels").filter(hash_bucket(F.col("doc_id"), 4) != 2)
    model = qualities.train(qualities.sample_labels(docs, labels))
    return qualities.score(docs, model, out=out).filter(F.col(out) >= 0.7).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class of texts: the row of smallest id (of rows with one id and one
    text that of smallest hash, rows without an id last). Of rows that repeat an id with different texts both can stay;
    null texts and texts without a word all stay."""
    bounded_batches(spark)
    return near_texts.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of at most 2048 ids (a null text is an empty one)."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", pack)]

# Learned models, signatures and packing can't be said in SQL; tests/llm checks the stages one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
