"""A corpus from raw documents to token ids, in five stages over whole tables.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of `documents`. `run` applies them in order; between stages the rows are written as Parquet to the folder that
all executors share and read again.

Rows without an id, and rows that repeat one, are documents like any other: each is scored, and leaves as a near duplicate only
by its own text. Columns beyond those of `documents` are left out. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from privasieve.llm import bpe, jaccard, mixing, pii, quality
from privasieve.llm.shared import documents, table, use_shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

BATCH_BYTES = 4 << 20  # of texts that go to a Python worker at once

# Python workers live on from stage to stage, several on an executor. Large arrays and batches go back to the system when they
# are freed; by default the allocators keep them for the worker's next task, beside the JVM's heap.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}

#: No SQL can express the trained network of the first stage, so none can express the rows of the last.
ORACLE_SQL = None


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes, whatever the length of the texts; a row is never cut. Workers give freed memory back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    score = quality.probability(spark, quality.train(docs, table(spark, sf_dir, "labels")))
    return docs.withColumn("score", score(F.col("text"))).filter(quality.predicted(F.col("score")) == 1).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id. Documents without shingles all stay."""
    bound_batches(spark)
    # Rows are named by id and text, as ids may repeat; rows without an id get one beyond all others, from their text.
    own = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3)).alias("own_id"), F.xxhash64("text").alias("digest"))
    linked = jaccard.join(own.select("own_id", "text"), id_column="own_id")
    kept = linked.filter("component_key IS NOT NULL").groupBy("component_key").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select("first.*")
    empty = linked.filter("component_key IS NULL").select("doc_id", "digest").distinct()
    wanted = kept.withColumn("alone", F.lit(True)).unionByName(empty.withColumn("alone", F.lit(False))).withColumnsRenamed({"doc_id": "own_id"})
    repeated = F.row_number().over(Window.partitionBy("own_id", "digest").orderBy("source", "lang", "text"))
    chosen = own.join(wanted, ["own_id", "digest"]).withColumn("place", repeated)
    return chosen.filter("NOT alone OR place = 1").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's budget takes them, the last one of a source cut to the rest."""
    # Ids may be null or repeat: a row is named by all it holds, and rows that are the same are one that is taken more often.
    name = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in COLUMNS)))
    own = docs.select(*COLUMNS, name.alias("own_id"))
    taken = mixing.mix(own, id_column="own_id").groupBy("doc_id").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    mix = mixing.draw(own.dropDuplicates(["own_id"]), taken, id_column="own_id")
    return mix.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digests of the ids and of the bytes that
    they decode to."""
    bound_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mix", mixed_sources),
    ("tokens", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
