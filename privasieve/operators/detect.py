"""Signal detection over documents.

A document is a row and its signals are an array in that row, worked out without a shuffle.
`detect_signals` turns them into rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checks import (
    amount_context_ok,
    personal_url,
    phone_context_ok,
    phone_run_ok,
    valid_card,
    valid_ipv4,
    valid_phone,
)
from ..functions.text import (
    SPAN,
    empty,
    java_regex,
    let,
    lines,
    match_spans,
    replaced,
    searchable,
    short_hash,
    signs,
)
from .labels import SIGNAL, label_signals, may_have_label, stacked_signals

_RULES = {rule.name: rule for rule in fixed.PATTERN_RULES}
_PHONE_RUN = r"[\d \-().+]*\d[\d \-().+]*"
_PHONE_DIGITS = 7  # the fewest of a valid phone number
_ENOUGH_DIGITS = rf"\d(?:[ \-().+]*+\d){{{_PHONE_DIGITS - 1}}}"


@dataclass(frozen=True)
class Limits:
    """Optional bounds of a scan. The default reads whole texts and keeps every signal."""

    scan_chars: int | None = None
    signals: int | None = None


BOUNDED = Limits(fixed.SCAN_CHARS, fixed.SIGNALS_PER_DOCUMENT)


# What is near a digit: of a stretch without digits its ends stay, so every cheap pattern with a digit in it is still found.
# The end may take part in the start again; blanks of any number between two parts of a pattern stay blanks.
_FAR = r"([^\p{Nd}]{6})[^\p{Nd}]++(?<=([^\p{Nd}]{6}))"
_DIGIT_RULES = ("iban", "phone", "employee_id", "ssn", "uk_nino", "ipv4", "uuid", "payment_card", "geo")
_HEX_RULES = ("ipv6", "mac")
_HEX_GROUP = "[:-][0-9A-Fa-f]{1,4}[:-]"


def _regexes(pattern: str, ignore_case: bool = False) -> tuple[str, str]:
    """A Python pattern for all texts, and for those of ASCII characters only."""
    return java_regex(pattern, ignore_case), java_regex(pattern, ignore_case, only_ascii=True)


def near_digits(text: Column, its_signs: Column | None = None) -> Column:
    """The parts of a text in which a pattern with a digit can be: empty for most texts, short for others."""
    told = text if its_signs is None else its_signs
    return F.when(told.rlike(r"\p{Nd}"), replaced(text, _FAR, _FAR.replace(r"\p{Nd}", "0-9"), "$1$2")).otherwise("")


def _hinted(name: str, digits: Column, hex_groups: Column) -> Column:
    """Whether the cheap pattern of a rule can be in a text, told from what was read of it once for all rules."""
    if name in _HEX_RULES:
        return hex_groups
    if name == "geo":  # blanks after the comma are cut short
        return digits.rlike(java_regex(r"(?:,\s*|\s{5})[-+]?\d"))
    return digits.rlike(java_regex(_RULES[name].needs)) if name in _DIGIT_RULES else F.lit(True)


def pattern_spans(text: Column, name: str) -> Column:
    """Every match of one pattern rule, before its value and context checks."""
    rule = _RULES[name]
    return _if_possible(text, rule, match_spans(text, *_regexes(rule.pattern, rule.ignore_case)))


def _if_possible(text: Column, rule: fixed.PatternRule, spans: Column) -> Column:
    """Look for matches only in texts that can have one; most texts fail the cheap test."""
    if all(c.isalnum() or c in "@:/|" for c in rule.needs):
        test = reduce(or_, [text.contains(word) for word in rule.needs.split("|")])
    else:
        test = text.rlike(java_regex(rule.needs))
    return F.when(test, spans).otherwise(empty(SPAN))


def phone_candidates(text: Column, only_possible: bool = True) -> Column:
    """Phone-like matches with `run_ok`: whether the digit run around the match allows a phone.

    The text is cut into runs of digits and phone punctuation first, so the test of a match reads
    its own run and not the document. With `only_possible`, runs that cannot pass are left out.
    """
    regexes = _regexes(fixed.PHONE)

    def in_run(run: Column) -> Column:
        first = F.greatest(run["start"] - 1, F.lit(0))
        piece = F.substring(text, first + 1, run["end"] + 1 - first)
        return let(
            piece,
            lambda p: F.transform(
                match_spans(p, *regexes),
                lambda m: F.struct(
                    (m["start"] + first).alias("start"),
                    (m["end"] + first).alias("end"),
                    m["value"].alias("value"),
                    phone_run_ok(p, m["start"], m["end"]).alias("run_ok"),
                ),
            ),
        )

    # A run of less than 7 digits or more than 15 ASCII digits can hold no phone number; one of more digits in other scripts may.
    def possible(run: Column) -> Column:
        count = F.length(F.regexp_replace(run["value"], r"[^\p{Nd}]", ""))
        return (count >= _PHONE_DIGITS) & ((count <= 15) | run["value"].rlike(r"[\p{Nd}&&[^0-9]]"))

    runs = match_spans(text, *_regexes(_PHONE_RUN))
    if only_possible:
        runs = F.filter(runs, possible)
    found = F.flatten(F.transform(runs, in_run))
    needed = _ENOUGH_DIGITS if only_possible else _RULES["phone"].needs
    return F.when(text.rlike(java_regex(needed)), found).otherwise(
        empty("struct<start:int,end:int,value:string,run_ok:boolean>")
    )


def rule_spans(text: Column, name: str) -> Column:
    """Matches of one pattern rule that pass its checks, in text order."""
    if name == "phone":
        spans = F.filter(phone_candidates(text), lambda m: m["run_ok"] & valid_phone(m["value"]))
        return F.filter(
            spans, lambda m: phone_context_ok(text, m["start"], m["end"], m["value"])
        )
    spans = pattern_spans(text, name)
    if name == "amount":
        return F.filter(spans, lambda m: amount_context_ok(text, m["start"], m["end"]))
    check = {"ipv4": valid_ipv4, "payment_card": valid_card, "url": personal_url}.get(name)
    return spans if check is None else F.filter(spans, lambda m: check(m["value"]))


def pattern_snippet(rule: fixed.PatternRule) -> str:
    return f"{rule.signal_type.replace('_', ' ').title()}: {rule.marker}"


def line_number_at(text: Column, start: Column) -> Column:
    """1 + line feeds before an offset."""
    before = F.substring(text, F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def first_per_key(signals: Column) -> Column:
    """Keep the first signal of every (type, snippet), in order. Sorts, so long arrays stay cheap."""
    keyed = F.transform(
        signals,
        lambda s, i: F.struct(s["type"].alias("type"), s["snippet"].alias("snippet"), i.alias("at"), s.alias("signal")),
    )

    def firsts(rows: Column) -> Column:
        def is_first(r: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)
            return (i == 0) | (before["type"] != r["type"]) | (before["snippet"] != r["snippet"])

        kept = F.transform(F.filter(rows, is_first), lambda r: F.struct(r["at"], r["signal"]))
        return F.transform(F.array_sort(kept), lambda r: r["signal"])

    return F.when(F.size(signals) < 2, signals).otherwise(let(F.array_sort(keyed), firsts))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _stronger(weaker: Column, other: Column) -> Column:
    tests = [
        (weaker["type"] == kind) & other["type"].isin(*stronger)
        for kind, stronger in fixed.STRONGER_TYPES.items()
    ]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def not_blocked(signals: Column, accepted: Column) -> Column:
    """Drop signals that an accepted one makes superfluous: same key, overlapping span of the
    same type, or overlapping span of a stronger type."""

    def blocks(s: Column, a: Column) -> Column:
        same_key = (a["type"] == s["type"]) & (a["snippet"] == s["snippet"])
        return same_key | (_overlaps(a, s) & ((a["type"] == s["type"]) | _stronger(s, a)))

    return F.filter(signals, lambda s: ~F.exists(accepted, lambda a: blocks(s, a)))


def _pattern_signal(text: Column, name: str, accepted: Column, possible: Column) -> Column:
    """The first match of one rule that no accepted label signal blocks, null if none or if none is `possible`.

    The snippet of a pattern rule is constant, so a rule can give at most one signal per document.
    """
    rule = _RULES[name]
    stronger = fixed.STRONGER_TYPES.get(rule.signal_type, ())
    same_key = F.exists(
        accepted,
        lambda a: (a["type"] == rule.signal_type) & (a["snippet"] == pattern_snippet(rule)),
    )
    rivals = F.filter(accepted, lambda a: a["type"].isin(rule.signal_type, *stronger))
    free = F.filter(
        rule_spans(text, name), lambda m: ~F.exists(rivals, lambda a: _overlaps(m, a))
    )
    return let(
        F.when(possible & ~same_key, F.get(free, F.lit(0))),
        lambda m: F.when(
            m.isNotNull(),
            F.struct(
                F.lit(rule.signal_type).alias("type"),
                F.lit(rule.detector).alias("detector"),
                F.lit(rule.confidence).alias("confidence"),
                F.lit(pattern_snippet(rule)).alias("snippet"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                line_number_at(text, m["start"]).alias("line_number"),
            ),
        ),
    )




def hold(data: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-row generator.

    The optimizer moves filters below projections by copying the column's expression into the
    filter, and a chain of long expressions copied into each other grows without bound. It never
    moves a filter on a generated column.
    """
    return data.select("*", F.explode(F.array(value)).alias(name))


@cache
def _stages() -> dict[str, Column]:
    """The detection expressions by column name. They are long, so they are built once."""
    text, its_signs = F.col("_text"), F.col("_signs")
    labels, stacked, accepted = F.col("_labels"), F.col("_stacked"), F.col("_accepted")
    hints = F.col("_digits"), F.col("_hex")
    found = F.array(*[_pattern_signal(text, r.name, accepted, _hinted(r.name, *hints)) for r in fixed.PATTERN_RULES])
    return {
        "_signs": signs(text),
        "_digits": near_digits(text, its_signs),
        "_hex": its_signs.rlike("(?s)[:-].*[:-]") & text.rlike(_HEX_GROUP),
        "_lines": lines(text, its_signs),
        "_labels": F.when(~may_have_label(text, its_signs), empty(SIGNAL)).otherwise(label_signals(F.col("_lines"))),
        "_stacked": stacked_signals(F.col("_lines")),
        "_first": first_per_key(labels),
        "_accepted": F.concat(
            F.col("_first"), first_per_key(not_blocked(stacked, F.col("_first")))
        ),
        "_found": F.filter(found, lambda s: s.isNotNull()),
        "signals": F.concat(accepted, first_per_key(F.col("_found"))),
    }


def with_signals(documents: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Add `signals`: the accepted signals of each document, in order of acceptance."""
    kept = documents.columns
    staged = documents.withColumn("_text", searchable(F.col(text), limits.scan_chars))
    *steps, (name, signals) = _stages().items()
    for step, value in steps:
        staged = staged.withColumn(step, value)
    if limits.signals is not None:
        signals = F.slice(signals, 1, limits.signals)
    return hold(staged, name, signals).select(*kept, name)


def detect_signals(
    documents: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """One row per accepted signal: key, seq (from 1), type, detector, confidence, snippet, span."""
    found = with_signals(documents.select(key, text), text, limits)
    return found.select(key, F.posexplode("signals").alias("seq", "s")).select(
        key, (F.col("seq") + 1).alias("seq"), "s.*"
    )


def rule_matches(documents: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Every checked match of some pattern rules, as positions with a hash of the value."""
    text = searchable(F.col("text"))

    def named(name: str) -> Column:
        return F.transform(
            rule_spans(F.col("_text"), name),
            lambda m: F.struct(F.lit(name).alias("rule"), m.alias("m")),
        )

    per_rule = F.flatten(F.array(*[named(name) for name in names]))
    return (
        documents.select(key, text.alias("_text"))
        .select(key, F.explode(per_rule).alias("x"))
        .select(
            key,
            F.col("x.rule").alias("rule"),
            F.col("x.m.start").alias("start"),
            F.col("x.m.end").alias("end"),
            short_hash(F.col("x.m.value"), 16).alias("value_hash"),
        )
    )


def flagged_signals(documents: DataFrame, limits: Limits = BOUNDED, key: str = "doc_id") -> DataFrame:
    """All signals of whole texts; `beyond_cap` and `beyond_window` mark those that a bounded scan would not show."""
    found = detect_signals(documents, key)
    return found.withColumns({"beyond_cap": F.col("seq") > limits.signals, "beyond_window": F.col("end") > limits.scan_chars})


def raw_spans(documents: DataFrame, regex: str, key: str = "doc_id") -> DataFrame:
    """Every match of any pattern with its position."""
    return (
        documents.select(key, searchable(F.col("text")).alias("_text"))
        .select(key, F.posexplode(match_spans(F.col("_text"), regex)).alias("i", "m"))
        .select(
            key,
            (F.col("i") + 1).alias("match_number"),
            F.col("m.start").alias("start"),
            F.col("m.end").alias("end"),
            short_hash(F.col("m.value"), 16).alias("value_hash"),
        )
    )


def phone_checks(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every phone-like match with the three tests it has to pass, told inside the document's row."""
    found = hold(documents.select(key, searchable(F.col("text")).alias("_text")), "_found", phone_candidates(F.col("_text"), only_possible=False))

    def tested(m: Column) -> Column:
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            valid_phone(m["value"]).alias("valid"),
            m["run_ok"].alias("run_ok"),
            phone_context_ok(F.col("_text"), m["start"], m["end"], m["value"]).alias("context_ok"),
        )

    return hold(found, "_tested", F.transform("_found", tested)).select(key, F.inline("_tested"))


def amount_checks(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every amount with the test for a personal word near it, told inside the document's row."""
    found = hold(documents.select(key, searchable(F.col("text")).alias("_text")), "_found", pattern_spans(F.col("_text"), "amount"))

    def tested(m: Column) -> Column:
        context = amount_context_ok(F.col("_text"), m["start"], m["end"])
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), context.alias("context_ok"))

    return hold(found, "_tested", F.transform("_found", tested)).select(key, F.inline("_tested"))


def scan_window(documents: DataFrame, limits: Limits, key: str = "doc_id") -> DataFrame:
    """How much of each text a bounded scan reads."""
    window = F.length(searchable(F.col("text"), limits.scan_chars))
    return documents.select(
        key, window.alias("scanned_chars"), (F.length("text") > window).alias("cut")
    )


def stacked_only(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stacked-label signals before the acceptance rules."""
    text = documents.select(key, lines(searchable(F.col("text"))).alias("_lines"))
    return text.select(key, F.explode(stacked_signals(F.col("_lines"))).alias("s")).select(key, "s.*")


def document_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return (
        documents.select(key, searchable(F.col("text")).alias("_text"))
        .select(key, F.explode(lines(F.col("_text"))).alias("ln"))
        .select(key, "ln.*")
    )


def type_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("type").agg(F.count("*").alias("signals")).orderBy("type")


def type_files(signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents per type. Signals of a document are first reduced to one row per type."""
    return (
        signals.groupBy("type", key).agg(F.lit(1).alias("one"))
        .groupBy("type").agg(F.count("*").alias("files")).orderBy("type")
    )
