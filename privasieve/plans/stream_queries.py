"""Queries for the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.files import shared_folder
from ..streaming import jobs
from .oracle_base import SIGNALS
from .registry import positions, query


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, directory):
    rows = jobs.read_stream(spark, directory, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


_OF_DOCUMENTS = "FROM sig WHERE doc_id IN (SELECT doc_id FROM documents)"


@query("stm_detect", "doc_id bigint, seq int, type varchar, start_pos int, end_pos int",
       f"SELECT doc_id, seq, type, s AS start_pos, e AS end_pos {_OF_DOCUMENTS}", SIGNALS)
def detect(spark, directory):
    documents = jobs.read_stream(spark, directory, "documents.parquet")
    return positions(jobs.detect_stream(spark, documents, _folder(spark)))


@query("stm_delta", "doc_id bigint, seq int, type varchar, batch_id bigint", f"SELECT doc_id, seq, type, 0 AS batch_id {_OF_DOCUMENTS}", SIGNALS)
def delta(spark, directory):
    documents = jobs.read_stream(spark, directory, "documents.parquet")
    files = documents.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).withColumn("size_bytes", F.octet_length("text"))
    return jobs.delta_stream(spark, files, _folder(spark))


_WINDOW_COLUMNS = "window_start timestamp, event_type varchar, events bigint"


@query("stm_audit_windows", _WINDOW_COLUMNS, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def windows(spark, directory):
    return jobs.audit_windows(spark, _events(spark, directory), _folder(spark))


@query("stm_audit_sliding_windows", _WINDOW_COLUMNS,
       "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start, event_type, count(*) AS events FROM events, range(0, 2) t(k) GROUP BY 1, 2")
def sliding(spark, directory):
    return jobs.audit_windows(spark, _events(spark, directory), _folder(spark), slide="30 minutes")


@query(
    "stm_review_sessions", "user_id bigint, session_start timestamp, session_end timestamp, events bigint",
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM "
    "(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, g "
    "HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def sessions(spark, directory):
    return jobs.review_sessions(spark, _events(spark, directory), _folder(spark))


@query("stm_idempotent", "key varchar, copies bigint", "SELECT DISTINCT concat(user_id, '_', event_type) AS key, 1 AS copies FROM events")
def idempotent(spark, directory):
    keyed = _events(spark, directory).withColumn("key", F.concat_ws("_", F.col("user_id").cast("string"), "event_type"))
    return jobs.first_of_key(spark, keyed, _folder(spark), "key").groupBy("key").agg(F.count("*").alias("copies"))
