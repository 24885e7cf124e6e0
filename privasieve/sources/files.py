"""File trees as sources, and result tables as sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import classify, decode_text, size_gate, suffix_of

# Content types of text files by suffix.
TEXT_TYPES = {
    ".txt": "text/plain", ".log": "text/plain", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json", ".ndjson": "application/x-ndjson",
    ".xml": "application/xml", ".html": "text/html", ".htm": "text/html", ".md": "text/markdown", ".vtt": "text/vtt", ".srt": "application/x-subrip",
}


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a folder without their content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        .select("path", "modificationTime", F.col("length").alias("size_bytes"))
        .withColumn("name", F.element_at(F.split("path", "/"), -1))
    )


def media_type_of(name):
    """The content type that a file's suffix stands for, where its content is text; empty for files without a suffix."""
    suffix = suffix_of(name)
    return F.when(suffix == "", "").otherwise(
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TEXT_TYPES.items() for x in pair]), suffix), F.lit("application/octet-stream"))
    )


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Text files below a folder, decoded. Files above their size limit are named in `rejected` and keep their text."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        .withColumnRenamed("length", "size_bytes").withColumn("name", F.element_at(F.split("path", "/"), -1))
    )
    gated = size_gate(files).withColumn("content_type", media_type_of(F.col("name")))
    # A tree of files declares no charset, so all bytes are decoded in the JVM; see with_decoded_text for other sources.
    return gated.select(
        "path", "name", "content_type", "size_bytes", suffix_of(F.col("name")).alias("suffix"), "rejected",
        classify(F.col("name"), F.col("content_type")).alias("format"), decode_text(F.col("content"), F.col("content_type")).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="privasieve-")


def write_results(frame: DataFrame, path: str) -> None:
    """Replace the partitions of the scans at hand and leave all others."""
    (
        frame.hint("rebalance", "source_id", "scan_id").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "scan_id").parquet(path)
    )


def purge(results: DataFrame, deleted_sources: DataFrame) -> DataFrame:
    return results.join(deleted_sources.select("source_id").distinct(), "source_id", "left_anti")
