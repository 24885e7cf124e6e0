"""Counts over files, methods, formats and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash

DIFFICULTIES = ("easy", "moderate", "hard", "unsupported")


def inventory_summary(files: DataFrame, flagged: DataFrame) -> DataFrame:
    """Candidate files, bytes and flagged files per source and family.

    Files are reduced to one row per family before anything else is shuffled.
    """
    candidates = files.groupBy("source_id", "family").agg(
        F.count("*").alias("candidate_files"), F.sum("size_bytes").alias("bytes")
    )
    found = flagged.groupBy("source_id", "family").agg(F.count("*").alias("flagged_files"))
    return candidates.join(found, ["source_id", "family"], "left").fillna(0, ["flagged_files"])


def method_counts(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Files per extraction method, deferred and unsupported files included."""
    done = documents.groupBy(F.col("extraction_method").alias("method")).agg(F.count("*").alias("files"))
    failed = failures.agg(
        F.count_if(F.col("difficulty") == "ocr_deferred").alias("ocr_deferred"), F.count("*").alias("all")
    )
    late = documents.agg(F.count_if("ocr_deferred").alias("late"))
    extra = failed.crossJoin(late).select(
        F.inline(
            F.array(
                F.struct(F.lit("ocr_deferred").alias("method"), (F.col("ocr_deferred") + F.col("late")).alias("files")),
                F.struct(F.lit("unsupported").alias("method"), (F.col("all") - F.col("ocr_deferred")).alias("files")),
            )
        )
    ).filter("files > 0")
    status = F.when(F.col("method").isin("ocr_deferred", "unsupported"), "warning").otherwise("completed")
    return done.unionByName(extra).withColumn("status", status)


def format_counts(documents: DataFrame, failures: DataFrame) -> DataFrame:
    deferred = F.col("difficulty") == "ocr_deferred"
    failed = failures.select(
        F.when(deferred, "ocr_deferred").otherwise("unsupported").alias("format"),
        F.when(deferred, "hard").otherwise(F.col("difficulty")).alias("difficulty"),
        F.when(deferred, "ocr_deferred").otherwise("unsupported").alias("method"),
    )
    done = documents.select(
        F.col("file_format").alias("format"), "difficulty", F.col("extraction_method").alias("method")
    )
    return done.unionByName(failed).groupBy("format", "difficulty", "method").agg(F.count("*").alias("files"))


def difficulty_counts(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Files per difficulty, every known level present."""
    level = F.when(F.col("difficulty") == "ocr_deferred", "hard").otherwise(F.col("difficulty"))
    counted = (
        documents.select("difficulty").unionByName(failures.select(level.alias("difficulty")))
        .groupBy("difficulty").agg(F.count("*").alias("files"))
    )
    levels = counted.sparkSession.createDataFrame([(d,) for d in DIFFICULTIES], "difficulty string")
    return levels.join(counted, "difficulty", "left").fillna(0, ["files"])


def batch_totals(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of totals over read and failed files."""
    done = documents.agg(
        F.count("*").alias("read_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("read_bytes"),
        F.count_if("ocr_deferred").alias("late"),
        F.count_if((F.size("warnings") > 0) | F.col("ocr_deferred")).alias("warned"),
    )
    failed = failures.agg(
        F.count("*").alias("unsupported_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("failed_bytes"),
        F.count_if(F.col("difficulty") == "ocr_deferred").alias("failed_deferred"),
    )
    return done.crossJoin(failed).select(
        (F.col("read_files") + F.col("unsupported_files")).alias("total_files"),
        (F.col("read_bytes") + F.col("failed_bytes")).alias("total_bytes"),
        "unsupported_files",
        (F.col("late") + F.col("failed_deferred")).alias("ocr_deferred_files"),
        (F.col("unsupported_files") + F.col("warned")).alias("warning_files"),
    )


def batch_warnings(documents: DataFrame) -> DataFrame:
    """Warnings of documents as counted rows, so that the list never has to fit in one row."""
    return documents.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("files"))


def reproducibility(source_id: Column, files: Column, signals: Column) -> Column:
    key = F.concat_ws(":", source_id, files.cast("string"), signals.cast("string"))
    return F.concat(F.lit("sha256:"), short_hash(key, 24))


def scan_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per source with the numbers of every stage of its scan."""
    inventory = files.groupBy("source_id").agg(
        F.count("*").alias("total_files"), F.sum("size_bytes").alias("total_bytes")
    )
    found = findings.groupBy("source_id").agg(
        F.count("*").alias("flagged_files"),
        F.sum("evidence_signal_count").alias("detected_signals"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"),
        F.count_if(F.col("risk_level") == "medium").alias("medium_risk"),
        F.count_if(F.col("owner_user_id").isNotNull()).alias("assigned_findings"),
        F.count_if(F.col("assignment_type") == "direct_owner").alias("direct_owner"),
        F.count_if(F.col("assignment_type") == "data_steward_fallback").alias("steward_fallback"),
    )
    counts = [c for c in found.columns if c != "source_id"]
    joined = inventory.join(found, "source_id", "left").fillna(0, counts)
    return joined.withColumn("unowned_findings", F.col("flagged_files") - F.col("assigned_findings")).withColumn(
        "reproducibility", reproducibility(F.col("source_id"), F.col("total_files"), F.col("detected_signals"))
    )


def scan_metrics(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("total_files").alias("total_scanned_files"),
        F.sum("flagged_files").alias("flagged_files"),
        F.round(F.sum("total_bytes") / 1e9, 4).alias("total_scanned_gb"),
        F.sum("flagged_files").alias("open_review_backlog"),
        F.sum("high_risk").alias("high_risk_findings"),
    )


def throughput(files: DataFrame, seconds: DataFrame, key: str = "suite") -> DataFrame:
    """Per suite and in total (suite null): files, characters, signals, and rates over summed time."""
    per_suite = files.groupBy(key).agg(
        F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("signals").alias("signals"),
        F.max("signals").alias("max_signals"),
    ).join(seconds, key)
    rolled = per_suite.rollup(key).agg(
        F.sum("files").alias("files"), F.sum("chars").alias("chars"), F.sum("signals").alias("signals"),
        F.max("max_signals").alias("max_signals"), F.sum("seconds").alias("seconds"),
    )
    return rolled.withColumn(
        "files_per_second", F.round(F.col("files") / F.nullif(F.col("seconds"), F.lit(0.0)), 3)
    ).withColumn("chars_per_second", F.round(F.col("chars") / F.nullif(F.col("seconds"), F.lit(0.0)), 1))
