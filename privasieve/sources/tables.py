"""Input tables as the entities of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forms import render_forms

BROADCAST_KEYS = 500_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(data: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread a few big input splits over all cores before text work.

    Costs a shuffle of the text, so it is done only where the input has fewer splits than cores.
    """
    cores = partitions or data.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() >= cores:
        return data
    return data.repartition(cores)


def apart_by_repeats(data: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key is there once, and those whose key repeats (None: there are none). Rows without a key are left out.

    Keys alone are counted for that, so no text is sent. A list of repeated keys of known, small size is broadcast; a longer one
    is joined like any table.
    """
    keyed = data.filter(F.col(key).isNotNull())
    repeats = keyed.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(key)
    many = repeats.count()
    if not many:
        return keyed, None
    side = F.broadcast(repeats) if many <= BROADCAST_KEYS else repeats
    return keyed.join(side, key, "left_anti"), keyed.join(side, key, "left_semi")


def source_documents(documents: DataFrame) -> DataFrame:
    """Documents of a source as files: path, name, size, family and extraction facts."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    return documents.select(
        "doc_id",
        "text",
        F.col("source").alias("source_id"),
        "lang",
        path.alias("path"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("lang").alias("family"),
        F.lit("txt").alias("file_format"),
        F.lit("utf8_text").alias("extraction_method"),
        F.lit("easy").alias("difficulty"),
    )


def corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Documents and rendered forms as one set of texts: doc_id, source, text."""
    documents = spread(table(spark, directory, "documents").select("doc_id", "source", "text"))
    customers = spread(table(spark, directory, "customer"))
    forms = render_forms(customers, table(spark, directory, "nation"))
    return documents.unionByName(forms)
