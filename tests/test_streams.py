"""Streams of several batches: late rows, repeats, and a restart."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from privasieve.plans import QUERIES
from privasieve.streaming import jobs

NOON = datetime(2024, 5, 1, 12)


def land(spark, directory, number: int, rows: list[tuple], schema: str) -> None:
    """One file more, later than all before it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{directory}/.part{number}")
    part = next(n for n in os.listdir(f"{directory}/.part{number}") if n.endswith(".parquet"))
    os.rename(f"{directory}/.part{number}/{part}", f"{directory}/{number}.parquet")
    os.utime(f"{directory}/{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event(i: int, minutes: int, user: int = 1, kind: str = "a") -> tuple:
    return (i, NOON + timedelta(minutes=minutes), user, kind, 1.0)


@pytest.fixture()
def landing(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in")


def test_windows_leave_out_late_rows(spark, landing, tmp_path):
    land(spark, landing, 1, [event(1, 0), event(2, 59), event(3, 61)], EVENTS)
    # The bound moves to 8 hours after noon when the second batch is done, and rows are held against it from the fourth on.
    land(spark, landing, 2, [event(4, 600), event(5, 1)], EVENTS)
    land(spark, landing, 3, [event(9, 602)], EVENTS)
    land(spark, landing, 4, [event(6, 2), event(7, 500), event(8, 601)], EVENTS)  # the first of these is too late
    folder = str(tmp_path / "out")
    stream = jobs.read_stream(spark, landing, "*.parquet", 1)
    got = {(r.window_start - NOON) // timedelta(minutes=60): r.events for r in jobs.audit_windows(spark, stream, folder).collect()}
    assert got == {0: 3, 1: 1, 8: 1, 10: 3}
    run = jobs.runs(spark, folder).first()
    assert (run.batches, run.late_rows) == (4, 1)


def test_sessions_close_after_the_bound(spark, landing, tmp_path):
    land(spark, landing, 1, [event(1, 0), event(2, 20), event(3, 0, user=2)], EVENTS)
    land(spark, landing, 2, [event(4, 45), event(5, 300, user=3)], EVENTS)
    land(spark, landing, 3, [event(8, 302, user=3)], EVENTS)
    land(spark, landing, 4, [event(6, 50), event(7, 301, user=3)], EVENTS)  # the session of the first is over
    stream = jobs.read_stream(spark, landing, "*.parquet", 1)
    got = {(r.user_id, r.events) for r in jobs.review_sessions(spark, stream, str(tmp_path / "out")).collect()}
    assert got == {(1, 3), (2, 1)}


def test_repeats_across_batches(spark, landing, tmp_path):
    land(spark, landing, 1, [event(1, 0), event(1, 1), event(2, 2)], EVENTS)
    land(spark, landing, 2, [event(1, 30), event(3, 31)], EVENTS)
    folder = str(tmp_path / "out")
    first = jobs.first_of_key(spark, jobs.read_stream(spark, landing, "*.parquet", 1), folder, "event_id")
    assert sorted(r.event_id for r in first.collect()) == [1, 2, 3]
    land(spark, landing, 3, [event(2, 33), event(4, 34)], EVENTS)  # after a restart
    again = jobs.first_of_key(spark, jobs.read_stream(spark, landing, "*.parquet", 1), folder, "event_id")
    assert sorted(r.event_id for r in again.collect()) == [1, 2, 3, 4]


FILES = "doc_id long, path string, text string, size_bytes long"


@pytest.mark.parametrize("name", ["stm_detect", "stm_delta"])
@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_may_be_one_file_or_a_folder_of_files(spark, tmp_path, name, parts):
    rows = [(i, f"mail a{i}@b.org", "src") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts or 1).write.parquet(f"{tmp_path}/made")
    if parts:
        os.rename(f"{tmp_path}/made", f"{tmp_path}/documents.parquet")
    else:
        part = next(n for n in os.listdir(f"{tmp_path}/made") if n.endswith(".parquet"))
        os.rename(f"{tmp_path}/made/{part}", f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.type) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == [(i, "email") for i in range(6)]


def document(i: int, text: str) -> tuple:
    return (i, f"p/{i}", text, len(text))


def test_delta_over_batches_and_a_restart(spark, landing, tmp_path):
    land(spark, landing, 1, [document(1, "mail a@b.org"), document(2, "plain")], FILES)
    land(spark, landing, 2, [document(1, "mail a@b.org"), document(2, "mail c@d.org")], FILES)  # one unchanged, one modified
    folder = str(tmp_path / "out")

    def run():
        found = jobs.delta_stream(spark, jobs.read_stream(spark, landing, "*.parquet", 1), folder)
        return sorted((r.batch_id, r.doc_id) for r in found.collect())

    assert run() == [(0, 1), (1, 2)]
    assert run() == [(0, 1), (1, 2)]  # nothing new
    land(spark, landing, 3, [document(2, "mail c@d.org"), document(3, "mail e@f.org")], FILES)
    assert run() == [(0, 1), (1, 2), (2, 3)]
    log = spark.read.parquet(f"{folder}/baseline")
    assert sorted((r.batch_id, r["count"]) for r in log.groupBy("batch_id").count().collect()) == [(0, 2), (1, 1), (2, 1)]
    assert sorted(r.batches for r in jobs.runs(spark, folder).collect()) == [0, 1, 2]
