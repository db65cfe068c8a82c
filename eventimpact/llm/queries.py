"""The registered queries of this folder: each derives its digest columns from its operator's own output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, language, main_text, near_texts, near_vectors, packing, quality, rans, sharding, spelling, topk, warc
from .common import bounded_batches, hash_bucket, read, shared_path
from .oracles import centroid_sql, spelling_sql


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labelled rows outside the held-out fold."""
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(hash_bucket(F.col("doc_id"), 4) != 2)
    model = quality.train(quality.sample_labels(docs, labels))
    got = quality.score(docs, model, keep=["doc_id"])
    return got.select("doc_id", (hash_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual rank file, and the bytes they decode to, as digests."""
    bounded_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    bounded_batches(spark)
    return packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose counts differ by at most one (law ``rows``)."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"))
    got = sharding.shard_rows(docs, ["doc_id", "size", "text_crc32"], 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    bounded_batches(spark)
    manifest = rans.write_tokens(read(spark, sf_dir, "documents"), shared_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return rans.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(hash_bucket(F.col("doc_id"), 3) != 1))
    got = language.detect(docs, model, keep=["doc_id"])
    return got.select("doc_id", (hash_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of all pages, written and read back."""
    bounded_batches(spark)
    records = warc.classify(read(spark, sf_dir, "pages"))
    got = warc.read_archive(warc.write_archive(records, shared_path(spark, "warc")))
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93 within a label."""
    bounded_batches(spark)
    return near_vectors.link_components(read(spark, sf_dir, "embeddings"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer products of every twentieth embedding with all others."""
    bounded_batches(spark)
    return topk.top_products(read(spark, sf_dir, "embeddings")).withColumn("rank", F.col("rank").cast("int"))


def op10_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    bounded_batches(spark)
    return near_texts.near_classes(read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, commoner form and root."""
    bounded_batches(spark, 20_000)
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    bounded_batches(spark)
    return main_text.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings, ten rounds."""
    bounded_batches(spark)
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_bpe, op3_packing, op4_sharding, op5_tokens, op6_language, op7_warc,
                                   op8_vectors, op9_topk, op10_near_texts, op11_spelling, op12_main_text, op13_centroids)}
ORACLES: dict[str, str] = {"op11_spelling": spelling_sql(), "op13_centroids": centroid_sql()}
