"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprint, jaccard, license_scan, mixing, pii, quality, ranked_search, repeats, secret_scan, sharding, topk
from .oracles import ORACLES
from .shared import documents, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_repeats(spark: SparkSession, directory: str) -> DataFrame:
    return repeats.find(documents(spark, directory))


def op2_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(documents(spark, directory), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, path, public_tokenizers.PATTERN))


def op3_conv_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    scored = quality.score(docs, quality.train(docs, table(spark, directory, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op4_exact_topk(spark: SparkSession, directory: str) -> DataFrame:
    vectors = table(spark, directory, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_iblt_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, directory))


def op6_weak_supervision_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii.report(pii.find(documents(spark, directory)))


def op7_prefix_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard.join(documents(spark, directory)).select("doc_id", "n_shingles", "component_id")


def op8_minimax_shards(spark: SparkSession, directory: str) -> DataFrame:
    return sharding.shard(documents(spark, directory)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_markov_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return secret_scan.report(secret_scan.find(documents(spark, directory)))


def op10_source_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(documents(spark, directory))


def op11_nra_search(spark: SparkSession, directory: str) -> DataFrame:
    return ranked_search.search(documents(spark, directory), table(spark, directory, "benchmark"))


def op12_diagonal_licenses(spark: SparkSession, directory: str) -> DataFrame:
    return license_scan.report(license_scan.scan(documents(spark, directory)))


def op13_chunk_divergence(spark: SparkSession, directory: str) -> DataFrame:
    return divergence.audit(documents(spark, directory))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_repeats, op2_byte_bpe, op3_conv_quality, op4_exact_topk, op5_iblt_fingerprints, op6_weak_supervision_pii, op7_prefix_jaccard, op8_minimax_shards,
        op9_markov_secrets, op10_source_mix, op11_nra_search, op12_diagonal_licenses, op13_chunk_divergence,
    )
}
