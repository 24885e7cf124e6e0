"""Baselines and delta scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash
from .findings import file_key


def content_fingerprint(text: Column, size_bytes: Column) -> Column:
    content = F.concat(text, F.lit("\u0000"), size_bytes.cast("string"))
    return F.concat(F.lit("sha256:"), short_hash(content, 32))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select(
        file_key(F.col("path")).alias("file_key"),
        content_fingerprint(F.col("text"), F.col("size_bytes")).alias("content_fingerprint"),
        "size_bytes",
    )


def inventory_fingerprint(records: DataFrame, key_chars: int = 3) -> DataFrame:
    """One hash over all files of an inventory, independent of their order of arrival.

    Two levels: files are hashed in key order within each key prefix, then the prefix hashes are
    hashed in prefix order. Keys are hash prefixes, so no row holds more than about one 4096th of
    them; raise `key_chars` for inventories beyond some billion files.
    """
    entry = F.concat_ws(":", "file_key", "content_fingerprint")
    groups = records.groupBy(F.substring("file_key", 1, key_chars).alias("prefix")).agg(
        F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(entry)), ";"), F.lit(";")), 256).alias("digest"),
        F.count("*").alias("files"),
    )
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda g: g["digest"]), ";")
    return groups.agg(
        F.concat(F.lit("sha256:"), short_hash(top, 32)).alias("inventory_fingerprint"),
        F.sum("files").alias("files"),
    )


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """new / modified / unchanged / missing for every file key of either side."""
    joined = baseline.select("file_key", F.col("content_fingerprint").alias("old")).join(
        current.select("file_key", F.col("content_fingerprint").alias("new")), "file_key", "full_outer"
    )
    change = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "missing")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("modified")
    )
    return joined.select("file_key", change.alias("change"))


def changed_documents(files: DataFrame, comparison: DataFrame) -> DataFrame:
    """Documents to scan again.

    A short list of changed keys is broadcast by adaptive execution, and the text is not moved. A long
    one is shuffled with the text, where a run-time Bloom filter can take out most unchanged files first.
    """
    changed = comparison.filter(F.col("change").isin("new", "modified")).select("file_key")
    return files.withColumn("file_key", file_key(F.col("path"))).join(changed, "file_key", "left_semi")


def carried_findings(previous: DataFrame, comparison: DataFrame) -> DataFrame:
    """Keys of files that had a finding and did not change."""
    unchanged = comparison.filter(F.col("change") == "unchanged").select("file_key")
    return previous.select("file_key").distinct().join(unchanged, "file_key", "left_semi")


def next_finding_keys(previous: DataFrame, comparison: DataFrame, current: DataFrame) -> DataFrame:
    """Finding keys of the next baseline: the carried ones and those found now."""
    return carried_findings(previous, comparison).union(current.select("file_key")).distinct()


def delta_summary(comparison: DataFrame, carried: DataFrame, reopened: DataFrame) -> DataFrame:
    """One row of counts. A missing file is a change of the source, never a deletion."""
    counts = comparison.agg(
        F.count_if(F.col("change").isin("new", "modified")).alias("changed_files"),
        F.count_if(F.col("change") == "new").alias("new_files"),
        F.count_if(F.col("change") == "modified").alias("modified_files"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged_files"),
        F.count_if(F.col("change") == "missing").alias("missing_files"),
    )
    return (
        counts.crossJoin(carried.agg(F.count("*").alias("carried_findings")))
        .crossJoin(reopened.agg(F.count("*").alias("reopened_findings")))
        .select(
            "*",
            F.col("changed_files").alias("processed_changed_files"),
            F.lit(False).alias("missing_treated_as_deleted"),
        )
    )


def pick_baseline(baselines: DataFrame, requested: DataFrame) -> DataFrame:
    """The latest baseline of each source, if the request names it or names none."""
    latest = baselines.groupBy("source_id").agg(
        F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("baseline_scan_id")
    )
    wanted = F.col("requested_scan_id")
    return latest.join(requested, "source_id").filter(
        wanted.isNull() | (wanted == "") | (wanted == F.col("baseline_scan_id"))
    ).select("source_id", "baseline_scan_id")
