"""Queries for signal detection."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checks import filled_value
from ..functions.text import short_hash
from ..operators import detect, labels
from ..sources.tables import corpus
from .oracle_base import CORPUS, LINES, SIGNALS, checks, filled, rule_hits, spans
from .registry import positions, query

SIGNAL_COLUMNS = (
    "doc_id bigint, seq int, type varchar, detector varchar, confidence double, snippet varchar, "
    "start_pos int, end_pos int, line_number int"
)
SIG_SQL = (
    "SELECT doc_id, seq, type, detector, confidence, snippet, s AS start_pos, e AS end_pos, line_number FROM sig"
)


_KEPT: dict[tuple, DataFrame] = {}


def signals(spark: SparkSession, directory: str, limits: detect.Limits = detect.Limits()) -> DataFrame:
    """The signals of the corpus. They are small and many queries start from them, so the rows are
    kept for the session; a lost part is worked out again from the input. Where the session's cache
    was cleared meanwhile, they are kept anew, so a query that uses them twice does not detect twice."""
    key = (spark.sparkContext.applicationId, directory, limits)
    if key not in _KEPT or _KEPT[key].storageLevel == StorageLevel.NONE:
        found = detect.detect_signals(corpus(spark, directory), limits=limits)
        _KEPT[key] = found.persist(StorageLevel.MEMORY_AND_DISK)
    return _KEPT[key]


def forget_signals() -> None:
    """Drop the kept signals, for example before a measurement."""
    for frame in _KEPT.values():
        frame.unpersist()
    _KEPT.clear()


def _lines(spark: SparkSession, directory: str) -> DataFrame:
    return detect.document_lines(corpus(spark, directory))


HIT_COLUMNS = "doc_id bigint, rule varchar, start_pos int, end_pos int, value_hash varchar"
HIT_SQL = "SELECT doc_id, rule, s AS start_pos, e AS end_pos, substring(sha256(v), 1, 16) AS value_hash FROM ({}) h"

for _name, _rules in {
    "det_email": ["email"],
    "det_iban": ["iban"],
    "det_phone": ["phone"],
    "det_employee_id": ["employee_id"],
    "det_tax_id": ["tax_id"],
    "det_amount": ["amount"],
    "det_ssn": ["ssn"],
    "det_uk_nino": ["uk_nino"],
    "det_ipv4": ["ipv4"],
    "det_ipv6": ["ipv6"],
    "det_mac": ["mac"],
    "det_uuid": ["uuid"],
    "det_payment_card": ["payment_card"],
    "det_geo": ["geo"],
    "det_url": ["url"],
    "det_handle": ["handle"],
}.items():

    @query(_name, HIT_COLUMNS, HIT_SQL.format(rule_hits(_rules)), CORPUS)
    def _rule_query(spark, directory, names=tuple(_rules)):
        return positions(detect.rule_matches(corpus(spark, directory), list(names)))


@query(
    "det_scan_window",
    "doc_id bigint, scanned_chars int, cut boolean",
    f"SELECT doc_id, length(substring(text, 1, {fixed.SCAN_CHARS})) AS scanned_chars, length(text) > {fixed.SCAN_CHARS} AS cut FROM corpus",
    CORPUS,
)
def scan_window(spark, directory):
    return detect.scan_window(corpus(spark, directory), detect.BOUNDED)


@query(
    "det_lines",
    "doc_id bigint, line_number int, start_pos int, line_hash varchar",
    "SELECT doc_id, line_number, line_start AS start_pos, substring(sha256(line), 1, 16) AS line_hash FROM ln "
    "WHERE NOT (line = '' AND line_number = (SELECT max(m.line_number) FROM ln m WHERE m.doc_id = ln.doc_id))",
    f"{CORPUS}, {LINES}",
)
def line_rows(spark, directory):
    return positions(_lines(spark, directory)).withColumn("line_hash", short_hash(F.col("line"), 16))


@query(
    "det_match_positions",
    "doc_id bigint, match_number int, start_pos int, end_pos int, value_hash varchar",
    "SELECT doc_id, n AS match_number, s AS start_pos, s + length(v) AS end_pos, substring(sha256(v), 1, 16) AS value_hash "
    f"FROM {spans('corpus', 'doc_id, text', 'text', '[0-9]+')} m",
    CORPUS,
)
def match_positions(spark, directory):
    return positions(detect.raw_spans(corpus(spark, directory), "[0-9]+"))


_PHONE_RAW = (
    f"FROM {spans('corpus', 'doc_id, text', 'text', fixed.PHONE)} m"
)


def _phone_part(spark, directory, column):
    return positions(detect.phone_checks(corpus(spark, directory))).withColumnRenamed(column, "passed")


_CHECK_COLUMNS = "doc_id bigint, start_pos int, end_pos int, passed boolean"
_PHONE_TESTS = checks("phone").split(" AND length(regexp_replace(concat(")
_RUN_TEST, _CONTEXT_TEST = ("length(regexp_replace(concat(" + _PHONE_TESTS[1]).rsplit(" AND (regexp_matches(v, '[+ ().-]')", 1)
for _name, _column, _test in (
    ("det_phone_valid", "valid", _PHONE_TESTS[0]),
    ("det_phone_digit_run", "run_ok", _RUN_TEST),
    ("det_phone_context", "context_ok", "(regexp_matches(v, '[+ ().-]')" + _CONTEXT_TEST),
):

    @query(_name, _CHECK_COLUMNS,
           f"SELECT doc_id, s AS start_pos, s + length(v) AS end_pos, ({_test}) AS passed {_PHONE_RAW}", CORPUS)
    def _phone_query(spark, directory, column=_column):
        return _phone_part(spark, directory, column)


@query(
    "det_amount_context", _CHECK_COLUMNS,
    f"SELECT doc_id, s AS start_pos, s + length(v) AS end_pos, {checks('amount')} AS passed "
    f"FROM {spans('corpus', 'doc_id, text', 'text', fixed.AMOUNT)} m", CORPUS,
)
def amount_context(spark, directory):
    return positions(detect.amount_checks(corpus(spark, directory))).withColumnRenamed("context_ok", "passed")


def _inline(spark, directory):
    lines = _lines(spark, directory)
    values = lines.select("doc_id", "line_number", F.col("start").alias("line_start"),
                          F.explode(labels.inline_values(F.col("line"))).alias("v"))
    return values.select("doc_id", "line_number", (F.col("line_start") + F.col("v.start")).alias("start_pos"),
                         (F.col("line_start") + F.col("v.end")).alias("end_pos"),
                         F.col("v.label").alias("label"), F.col("v.value").alias("value"))


@query(
    "det_inline_labels", "doc_id bigint, line_number int, label varchar, start_pos int, end_pos int",
    "SELECT doc_id, line_number, label, line_start + vs AS start_pos, line_start + vs + length(v) AS end_pos FROM inline_values",
    SIGNALS,
)
def inline_labels(spark, directory):
    return _inline(spark, directory)


@query(
    "det_filled_value", "doc_id bigint, line_number int, start_pos int, filled boolean",
    f"SELECT doc_id, line_number, line_start + vs AS start_pos, {filled('v')} AS filled FROM inline_values", SIGNALS,
)
def filled_values(spark, directory):
    return _inline(spark, directory).withColumn("filled", filled_value(F.col("value")))


@query(
    "det_label_line", "doc_id bigint, line_number int, type varchar, snippet varchar, start_pos int, end_pos int",
    "SELECT doc_id, line_number, type, label || ': ' || marker AS snippet, line_start + vs AS start_pos, "
    "line_start + vs + length(v) AS end_pos FROM label_sig l JOIN rules USING (rule) WHERE NOT EXISTS "
    "(SELECT 1 FROM inline_sig i WHERE i.doc_id = l.doc_id AND i.line_number = l.line_number)",
    SIGNALS,
)
def label_lines(spark, directory):
    line = F.struct("line_number", "start", "line")
    return positions(
        _lines(spark, directory).select("doc_id", F.explode(labels.whole_line_signals(line)).alias("s"))
        .select("doc_id", "s.*")
    )


@query(
    "det_stacked_labels",
    "doc_id bigint, type varchar, detector varchar, confidence double, snippet varchar, start_pos int, end_pos int, line_number int",
    "SELECT doc_id, type, detector, confidence, snippet, s AS start_pos, e AS end_pos, line_number FROM stack_all",
    SIGNALS,
)
def stacked(spark, directory):
    return positions(detect.stacked_only(corpus(spark, directory)))


_RULED_SQL = (
    "SELECT doc_id, line_number, label, type, detector, confidence FROM inline_ruled JOIN rules USING (rule) "
    "WHERE detector {} 'multilingual%'"
)
_RULED_COLUMNS = "doc_id bigint, line_number int, label varchar, type varchar, detector varchar, confidence double"


def _ruled(spark, directory):
    rule = labels.classified(F.col("label"), F.col("value"))
    found = detect.hold(_inline(spark, directory), "rule", rule)
    return found.filter("rule is not null").select("doc_id", "line_number", "label", "rule.*")


@query("det_multilingual_label", _RULED_COLUMNS, _RULED_SQL.format("LIKE"), SIGNALS)
def multilingual(spark, directory):
    return _ruled(spark, directory).filter(F.col("detector").startswith("multilingual"))


@query("det_english_label", _RULED_COLUMNS, _RULED_SQL.format("NOT LIKE"), SIGNALS)
def english(spark, directory):
    return _ruled(spark, directory).filter(~F.col("detector").startswith("multilingual"))


@query("det_accept", SIGNAL_COLUMNS, SIG_SQL, SIGNALS)
def accept(spark, directory):
    return positions(signals(spark, directory))


@query("det_signal_cap", SIGNAL_COLUMNS, SIG_SQL + f" WHERE seq <= {fixed.SIGNALS_PER_DOCUMENT}", SIGNALS)
def cap(spark, directory):
    return positions(signals(spark, directory, detect.BOUNDED))


@query("det_signal_type_counts", "type varchar, signals bigint",
       "SELECT type, count(*) AS signals FROM sig GROUP BY type", SIGNALS)
def counts(spark, directory):
    return detect.type_counts(signals(spark, directory))


@query("det_signal_type_files", "type varchar, files bigint",
       "SELECT type, count(DISTINCT doc_id) AS files FROM sig GROUP BY type", SIGNALS)
def files(spark, directory):
    return detect.type_files(signals(spark, directory))


@query("det_signal_flags", "doc_id bigint, seq int, beyond_cap boolean, beyond_window boolean", "SELECT doc_id, seq, seq > 32 AS beyond_cap, e > 200000 AS beyond_window FROM sig", SIGNALS)
def signal_flags(spark, directory):
    return detect.flagged_signals(corpus(spark, directory))
