"""The full scan and the delta scan as lazy plans over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delta, detect, findings


def full_scan(files: DataFrame, sources: DataFrame, scan_id: str, limits: detect.Limits = detect.Limits()) -> DataFrame:
    """Findings of all files: one pass over the text, no shuffle before the owner join."""
    return findings.assemble_findings(detect.with_signals(files, limits=limits), sources, scan_id)


def delta_scan(
    baseline: DataFrame, files: DataFrame, sources: DataFrame, scan_id: str
) -> tuple[DataFrame, DataFrame]:
    """Comparison with the baseline, and findings of new and modified files only."""
    comparison = delta.compare(baseline, delta.fingerprints(files))
    changed = delta.changed_documents(files, comparison)
    return comparison, full_scan(changed, sources, scan_id)


def corpus_files(corpus: DataFrame) -> DataFrame:
    """Texts as files of their source."""
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    return corpus.select(
        "doc_id", "text", F.col("source").alias("source_id"),
        F.concat_ws("/", "source", name).alias("path"), name.alias("name"),
        F.concat(F.lit("Family_"), F.length("source")).alias("family"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit("txt").alias("file_format"),
    )


def corpus_sources(corpus: DataFrame) -> DataFrame:
    """One row per source. A third of them has a named owner, a third a steward, a third nobody."""
    ids = corpus.select(F.col("source").alias("source_id")).distinct()
    kind = F.length("source_id") % 3
    return ids.select(
        "source_id",
        F.when(kind == 0, F.concat(F.lit("user_"), "source_id")).when(kind == 1, "user_steward").alias("owner_user_id"),
        F.when(kind == 0, "direct_owner").when(kind == 1, "data_steward_fallback").alias("assignment_type"),
    )
