"""Chained scans over a stored baseline.

The store is two tables in a shared folder, written by partition of source and scan: `files` (each file's fingerprint and whether it
has a finding) and `scans` (one row for each source and scan). A scan reads the latest baseline of its sources, compares
fingerprints, detects personal data in new and modified files only, carries the rest forward, and writes the next baseline. A
repeated scan id replaces its own partitions and nothing else. Texts are read for fingerprints; only changed ones are searched.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..operators import delta, detect
from ..operators.findings import file_key
from ..sources.files import write_results

FILES = "source_id string, scan_id string, file_key string, content_fingerprint string, size_bytes long, has_finding boolean"
SCANS = (
    "source_id string, scan_id string, created_at timestamp, baseline_scan_id string, baseline_fingerprint string, inventory_fingerprint string, total_files long, "
    "files_with_findings long, new_files long, modified_files long, unchanged_files long, missing_files long, carried_files long, reopened_files long"
)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first scan."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_baseline(spark: SparkSession, store: str, requested: DataFrame | None = None) -> DataFrame:
    """source_id and baseline_scan_id, fingerprint, files and findings of the latest scan of each source. `requested` (source_id,
    requested_scan_id) lets a source out whose latest scan is another one than asked for."""
    scans = stored(spark, f"{store}/scans", SCANS)
    wanted = scans.select("source_id", F.lit(None).cast("string").alias("requested_scan_id")).distinct() if requested is None else requested
    picked = delta.pick_baseline(scans, wanted)
    facts = scans.select("source_id", F.col("scan_id").alias("baseline_scan_id"), F.col("inventory_fingerprint").alias("baseline_fingerprint"))
    return picked.join(facts, ["source_id", "baseline_scan_id"])


def inventory_tree(records: DataFrame, leaf: int = 4096) -> DataFrame:
    """One hash over the files of each source, whatever their order: a hash tree over the keys, which are hex digests.

    Files are dealt by as many leading digits as make groups of about `leaf`; each further level hashes up to sixteen groups. So
    no row holds more than some `leaf` entries at any number of files.
    """
    most = records.groupBy("source_id").count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while most > leaf * 16**digits:
        digits += 1
    entry = F.concat_ws(":", "file_key", "content_fingerprint")
    level = records.groupBy("source_id", F.substring("file_key", 1, digits).alias("prefix")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ";"), 256).alias("digest"), F.count("*").alias("files")
    )
    for width in range(digits - 1, -1, -1):
        part = F.concat_ws(":", "prefix", "digest")
        level = level.groupBy("source_id", F.substring("prefix", 1, width).alias("prefix")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ";"), 256).alias("digest"), F.sum("files").alias("files")
        )
    return level.select("source_id", F.concat(F.lit("sha256:"), F.substring("digest", 1, 32)).alias("inventory_fingerprint"), F.col("files").alias("total_files"))


def scan(
    spark: SparkSession, store: str, files: DataFrame, scan_id: str, created_at: datetime, limits: detect.Limits = detect.Limits(), requested: DataFrame | None = None
) -> DataFrame:
    """Scan `files` (source_id, path, text, size_bytes) against the stored baseline and store the next one.

    Gives a row for each file of the baseline or of now: source_id, file_key, change, scanned, has_finding.
    """
    base = latest_baseline(spark, store, requested)
    before = stored(spark, f"{store}/files", FILES).join(
        base.select("source_id", F.col("baseline_scan_id").alias("scan_id")), ["source_id", "scan_id"], "left_semi"
    )
    sources = files.select("source_id").distinct()
    before = before.join(sources, "source_id", "left_semi").select(
        "source_id", "file_key", F.col("content_fingerprint").alias("old"), F.col("has_finding").alias("had")
    )
    keyed = files.withColumn("file_key", file_key(F.col("path")))
    now = keyed.select("source_id", "file_key", delta.content_fingerprint(F.col("text"), F.col("size_bytes")).alias("content_fingerprint"), "size_bytes")
    change = (
        F.when(F.col("old").isNull(), "new").when(F.col("content_fingerprint").isNull(), "missing")
        .when(F.col("old") == F.col("content_fingerprint"), "unchanged").otherwise("modified")
    )
    compared = now.join(before, ["source_id", "file_key"], "full_outer").withColumn("change", change)
    changed = compared.filter(F.col("change").isin("new", "modified")).select("source_id", "file_key")
    searched = detect.with_signals(keyed.join(changed, ["source_id", "file_key"], "left_semi").select("source_id", "file_key", "text"), limits=limits)
    found = searched.select("source_id", "file_key", (F.size("signals") > 0).alias("found"))
    told = compared.join(found, ["source_id", "file_key"], "left").withColumn(
        "has_finding", F.when(F.col("change") == "unchanged", F.col("had")).when(F.col("change") != "missing", F.col("found"))
    )
    # What is written is read again: detection runs once, and the counts are those of the stored rows.
    work = f"{store}/comparisons"
    write_results(told.select("source_id", F.lit(scan_id).alias("scan_id"), "file_key", "content_fingerprint", "size_bytes", "change", "has_finding", "had"), work)
    written = spark.read.schema(FILES + ", change string, had boolean").parquet(work).filter(F.col("scan_id") == scan_id).join(sources, "source_id", "left_semi")
    present = written.filter("change <> 'missing'")
    write_results(present.select("source_id", "scan_id", "file_key", "content_fingerprint", "size_bytes", "has_finding"), f"{store}/files")
    write_results(_summary(written, present, base, created_at), f"{store}/scans")
    return written.select("source_id", "file_key", "change", F.col("change").isin("new", "modified").alias("scanned"), "has_finding")


def _summary(written: DataFrame, present: DataFrame, base: DataFrame, created_at: datetime) -> DataFrame:
    """One row of the `scans` table for each source."""
    counts = written.groupBy("source_id", "scan_id").agg(
        F.count_if(F.col("has_finding")).alias("files_with_findings"),
        *(F.count_if(F.col("change") == c).alias(f"{c}_files") for c in ("new", "modified", "unchanged", "missing")),
        F.count_if((F.col("change") == "unchanged") & F.col("had")).alias("carried_files"),
        F.count_if((F.col("change") == "modified") & F.col("had") & F.col("has_finding")).alias("reopened_files"),
    )
    joined = counts.join(base, "source_id", "left").join(inventory_tree(present), "source_id", "left")
    return joined.select(
        "source_id", "scan_id", F.lit(created_at).cast("timestamp").alias("created_at"), "baseline_scan_id", "baseline_fingerprint", "inventory_fingerprint",
        F.coalesce("total_files", F.lit(0)).alias("total_files"), "files_with_findings", "new_files", "modified_files", "unchanged_files", "missing_files", "carried_files", "reopened_files",
    )


def delta_fingerprint(status: str):
    """Names a comparison: its baseline, its state and what changed."""
    suffix = F.concat_ws(":", (F.col("new_files") + F.col("modified_files")).cast("string"), F.col("missing_files").cast("string"))
    return F.concat(F.lit("sha256:"), short_hash(F.concat_ws(":", F.coalesce("baseline_fingerprint", F.lit("")), F.lit(status), suffix), 32))


def summaries(spark: SparkSession, store: str, scan_id: str) -> DataFrame:
    """What one scan changed, for each source. A missing file is a change of the source, never a deletion."""
    row = stored(spark, f"{store}/scans", SCANS).filter(F.col("scan_id") == scan_id)
    warnings = F.filter(
        F.array(
            F.when(F.col("unchanged_files") > 0, F.concat(F.col("unchanged_files"), F.lit(" unchanged files were carried forward"))),
            F.when(F.col("missing_files") > 0, F.concat(F.col("missing_files"), F.lit(" baseline files are missing from the source; nothing was deleted"))),
        ),
        lambda w: w.isNotNull(),
    )
    return row.withColumns({
        "changed_files": F.col("new_files") + F.col("modified_files"), "delta_fingerprint": delta_fingerprint("completed"),
        "missing_treated_as_deleted": F.lit(False), "warnings": warnings,
    })
