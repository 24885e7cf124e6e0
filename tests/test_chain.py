"""Chained scans over a stored baseline, declared charsets, and redaction that follows the input."""

from __future__ import annotations

import hashlib
import time
from datetime import datetime

from pyspark.sql import functions as F

from privasieve.operators import detect, inventory, redact
from privasieve.plans import chain
from privasieve.sources.files import write_results

SCHEMA = "source_id string, path string, text string, size_bytes long"


def files(spark, *rows):
    return spark.createDataFrame([(s, p, t, len(t)) for s, p, t in rows], SCHEMA)


def told(frame):
    paths = {hashlib.sha256(p.encode()).hexdigest()[:24]: p for p in "abcdex"}
    return {(r.source_id, paths[r.file_key]): (r.change, r.scanned, r.has_finding) for r in frame.collect()}


def test_two_chained_scans(spark, tmp_path):
    store = str(tmp_path / "store")
    first = files(spark, ("s1", "a", "mail a@b.org"), ("s1", "b", "nothing"), ("s1", "c", "mail c@b.org"), ("s2", "x", "mail x@y.org"))
    assert told(chain.scan(spark, store, first, "one", datetime(2024, 1, 1))) == {
        ("s1", "a"): ("new", True, True), ("s1", "b"): ("new", True, False), ("s1", "c"): ("new", True, True), ("s2", "x"): ("new", True, True)}
    # What an unchanged file has is read from the store: a mark that detection would not give is carried.
    kept = spark.read.schema(chain.FILES).parquet(f"{store}/files").filter("source_id = 's1'")
    marked = kept.withColumn("has_finding", F.col("has_finding") | (F.col("file_key") == hashlib.sha256(b"b").hexdigest()[:24]))
    columns = [c.split()[0] for c in chain.FILES.split(", ")]
    write_results(spark.createDataFrame(marked.select(columns).collect(), chain.FILES), f"{store}/files")
    second = files(spark, ("s1", "a", "mail a2@b.org"), ("s1", "b", "nothing"), ("s1", "d", "plain"))
    want = {("s1", "a"): ("modified", True, True), ("s1", "b"): ("unchanged", False, True), ("s1", "c"): ("missing", False, None), ("s1", "d"): ("new", True, False)}
    asked = spark.createDataFrame([("s1", "one")], "source_id string, requested_scan_id string")
    assert told(chain.scan(spark, store, second, "two", datetime(2024, 1, 2), requested=asked)) == want
    row = chain.summaries(spark, store, "two").collect()
    assert len(row) == 1
    row = row[0]
    assert (row.baseline_scan_id, row.changed_files, row.new_files, row.modified_files, row.unchanged_files, row.missing_files) == ("one", 2, 1, 1, 1, 1)
    assert (row.carried_files, row.reopened_files, row.files_with_findings, row.total_files) == (1, 1, 2, 3)
    assert len(row.warnings) == 2 and row.missing_treated_as_deleted is False
    third = told(chain.scan(spark, store, second, "three", datetime(2024, 1, 3)))
    assert {v[0] for v in third.values()} == {"unchanged"} and not any(v[1] for v in third.values())
    facts = {r.source_id: r for r in chain.latest_baseline(spark, store).collect()}
    assert facts["s1"].baseline_scan_id == "three" and facts["s2"].baseline_scan_id == "one"
    assert facts["s1"].baseline_fingerprint == row.inventory_fingerprint


def test_inventory_tree(spark):
    rows = [("s", hashlib.sha256(str(i).encode()).hexdigest()[:24], f"sha256:{i}") for i in range(500)] + [("t", "0" * 24, "x")]

    def node(entries, width, digits):
        entries = sorted(entries)
        if width == digits:
            return hashlib.sha256(";".join(f"{k}:{v}" for k, v in entries).encode()).hexdigest()
        groups = {}
        for k, v in entries:
            groups.setdefault(k[: width + 1], []).append((k, v))
        return hashlib.sha256(";".join(f"{p}:{node(g, width + 1, digits)}" for p, g in sorted(groups.items())).encode()).hexdigest()

    for leaf, digits in ((1000, 0), (100, 1), (5, 2)):
        got = {r.source_id: (r.inventory_fingerprint, r.total_files) for r in chain.inventory_tree(spark.createDataFrame(rows, "source_id string, file_key string, content_fingerprint string"), leaf).collect()}
        for source in ("s", "t"):
            own = [(k, v) for s, k, v in rows if s == source]
            assert got[source] == ("sha256:" + node(own, 0, digits)[:32], len(own))


def test_declared_charsets(spark):
    cases = [
        ("café “x”".encode("cp1252"), "text/plain; charset=windows-1252", "café “x”"), ("表示".encode("shift_jis"), "text/plain;charset=Shift_JIS", "表示"),
        ("中文".encode("gb18030"), 'text/plain; charset="GB18030"', "中文"), ("é".encode(), "text/plain; charset=x-unknown", "é"),
        (b"\xff\xfea\x00", "text/plain; charset=ascii", "a"), ("é".encode(), None, "é"), (b"\x81", "text/plain; charset=windows-1252", "�"), (None, "text/plain; charset=gb18030", None),
    ]
    frame = spark.createDataFrame([(i, None if raw is None else bytearray(raw), kind) for i, (raw, kind, _) in enumerate(cases)], "i int, content binary, content_type string")
    got = {r.i: r.text for r in inventory.with_decoded_text(frame).collect()}
    assert got == {i: text for i, (_, _, text) in enumerate(cases)}


def test_redaction_follows_the_input(spark):
    """Four times the signals in one document take less than eight times as long, and masks agree with a plain walk."""
    def document(n):
        spans = [(i * 40 + 5, i * 40 + 20) for i in range(n)] + [(60, 75)]
        text = "".join(f"at é{i:030d}\n   ."[:39] + "\n" for i in range(n + 1))
        rows = [("email", "d", 0.9, "x: [REDACTED_EMAIL]", a, b, 1) for a, b in spans]
        return text, rows

    schema = "doc_id long, text string, signals array<struct<type:string,detector:string,confidence:double,snippet:string,start:int,end:int,line_number:int>>"
    taken = {}
    for n in (1500, 1500, 6000):
        text, rows = document(n)
        frame = spark.createDataFrame([(1, text, rows)], schema).cache()
        frame.count()
        started = time.perf_counter()
        masked = redact.masked_documents(frame).first().masked_text
        windows = redact.context_windows(frame).count()
        taken[n] = time.perf_counter() - started
        assert windows == len(rows) and masked.count("[REDACTED_EMAIL]") >= n
    assert taken[6000] < 8 * taken[1500] + 1


def test_bounded_contexts(spark):
    text = "a" * 500 + "\n" + "b" * 200 + "mail a@b.org" + "c" * 300 + "\nend"
    frame = detect.with_signals(spark.createDataFrame([(1, text.replace("bmail", "b mail").replace("orgc", "org c"))], "doc_id long, text string"))
    row = redact.context_bounds(frame).first()
    assert row.context_end - row.context_start <= redact.MAX_CONTEXT and row.context_start >= 501
