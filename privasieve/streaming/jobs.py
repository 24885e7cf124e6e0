"""The same work on data as it lands.

Every job reads a file stream, takes what is there (or runs on, by its trigger), and writes to a
folder all executors see. Detection keeps no state: it is a projection of each document, so it
runs in a stream unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, detect


RUNS = "run_id string, batches int, late_rows long"


def read_stream(spark: SparkSession, directory: str, pattern: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the files of a folder that a pattern names; what it names may be a folder of part files itself."""
    # A pattern in braces stays a pattern where it has no wildcard: a stream reads one named path as a folder only.
    path = f"{directory}/{{{pattern}}}"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _finish(spark: SparkSession, writer, folder: str) -> None:
    """Run a job over what is there. Each run adds a row to the `runs` table of its folder: batches with rows, and rows that came
    later than the watermark and were left out."""
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = query.recentProgress
    late = sum(operator["numRowsDroppedByWatermark"] for step in steps for operator in step["stateOperators"])
    row = (str(query.runId), len([step for step in steps if step["numInputRows"]]), late)
    spark.createDataFrame([row], RUNS).write.mode("append").parquet(f"{folder}/runs")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of a job: run_id, batches, late_rows (groups of late rows, where rows are grouped before the state)."""
    return spark.read.schema(RUNS).parquet(f"{folder}/runs")


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows written by a job so far; none if it had nothing to write."""
    return spark.read.schema(schema).parquet(path)


def detect_stream(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """Signals of documents as they land."""
    found = detect.detect_signals(documents)
    _finish(spark, found.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/signals"), folder)
    return _written(spark, f"{folder}/signals", found.schema)


def delta_stream(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Compare each batch with the stored baseline, scan only what changed, and extend the baseline.

    The baseline is a log: every batch adds the fingerprints of its new and modified files under its
    own batch id, so a repeated batch replaces its part and nothing else. The last entry of a key counts. Only the keys of the batch
    are looked up in the log, so what is shuffled and compared follows the batch and not the log; of a key that a batch holds
    several times every version is compared.
    """
    log, out = f"{folder}/baseline", f"{folder}/signals"
    log_schema = "file_key string, content_fingerprint string, batch_id long"

    def step(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(log_schema).parquet(log).filter(F.col("batch_id") < batch_id) if batch_id else spark.createDataFrame([], log_schema)
        own = delta.fingerprints(batch).persist()
        known = known.join(own.select("file_key").distinct(), "file_key", "left_semi")
        last = known.groupBy("file_key").agg(F.max_by("content_fingerprint", "batch_id").alias("content_fingerprint"))
        compared = delta.compare(last, own).filter(F.col("change").isin("new", "modified"))
        changed = delta.changed_documents(batch, compared)
        for frame, path in ((delta.fingerprints(changed), log), (detect.detect_signals(changed), out)):
            frame.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        own.unpersist()

    _finish(spark, files.writeStream.foreachBatch(step), folder)
    return spark.read.parquet(out)


def audit_windows(spark: SparkSession, events: DataFrame, folder: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Audit events per window and type; rows later than the bound are left out."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = (
        events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    )
    rows = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch_id={batch_id}")

    _finish(spark, rows.writeStream.outputMode("update").foreachBatch(step), folder)
    keys = ["window_start", "window_end", "event_type"]
    updates = spark.read.parquet(f"{folder}/windows")
    return updates.groupBy(*keys).agg(F.max_by("events", "batch_id").alias("events"), F.max_by("value", "batch_id").alias("value"))


def review_sessions(spark: SparkSession, events: DataFrame, folder: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each reviewer that are certainly over."""
    sessions = (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    )
    rows = sessions.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    _finish(spark, rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/sessions"), folder)
    return _written(spark, f"{folder}/sessions", rows.schema)


def first_of_key(spark: SparkSession, events: DataFrame, folder: str, key: str, late: str = "1 hour") -> DataFrame:
    """Drop repeats of an idempotency key that arrive within the bound."""
    kept = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    _finish(spark, kept.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/kept"), folder)
    return _written(spark, f"{folder}/kept", kept.schema)
