"""Label/value detection: inline labels, whole-line labels, stacked labels.

All functions take and give columns of one line or one document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checks import EMPLOYEE_VALUE, PASSPORT_VALUE, filled_value, handle_value
from ..functions.text import (
    ASCII_SPACE,
    BLANKS,
    FIELD,
    MARK,
    SPACE,
    clean_label,
    contains_any,
    empty,
    fold,
    fold_text,
    is_wide,
    let,
    literal_alternation,
    replaced,
    running_starts,
    trim_blanks,
)

SIGNAL = (
    "struct<type:string,detector:string,confidence:double,snippet:string,"
    "start:int,end:int,line_number:int>"
)
LABEL_RULES = fixed.MULTILINGUAL_RULES + fixed.ENGLISH_RULES

# Blanks inside one line, the separators between a label and its value, and the scripts whose
# labels may be followed by a value without one.
_SEPARATOR = "[:：#=]|[-–—]"
_CJK = "[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]"
_CJK_ARABIC = "[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\u0600-\u06ff]"

_ALL = fixed.INLINE_LABELS + fixed.MULTILINGUAL_WORDS
_BLANK_LABELS = fixed.WHITESPACE_LABELS + tuple(w for w in _ALL if re.search(_CJK_ARABIC, w))
_BARE_LABELS = tuple(w for w in _ALL if re.search(_CJK, w))

_EXPLICIT = f"(?iu)({literal_alternation(_ALL)})([{SPACE}]*)({_SEPARATOR})([{SPACE}]*)"
_EXPLICIT_ASCII = f"(?i)({literal_alternation([w for w in _ALL if w.isascii()])})([{ASCII_SPACE}]*)([:#=-])([{ASCII_SPACE}]*)"
_BLANK = f"(?iu)({literal_alternation(_BLANK_LABELS)})(?=[{SPACE}]+[^{SPACE}])"
_BARE = f"(?iu)({literal_alternation(_BARE_LABELS)})"

_MARKS = r"[:#=\-]"
_PASSPORT = "(?i)passport"  # without (?u) only ASCII letters are alike: as in the lower-case text
_WIDE_MARKS = r"[：\u2013-\u2014\u0600-\u06ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]"  # wide separators and letters of those scripts
# At most six words, and one more for separators that stand alone.
_FEW_WORDS = (
    f"\\A[{SPACE}]*+(?:[^{SPACE}\\p{{N}}/\\\\|{{}}\\[\\]()]++(?:[{SPACE}]++|\\z)){{1,7}}\\z"
)
_FEW_ASCII_WORDS = f"\\A[{ASCII_SPACE}]*+(?:[^{ASCII_SPACE}0123456789/\\\\|{{}}\\[\\]()]++(?:[{ASCII_SPACE}]++|\\z)){{1,7}}\\z"
_LABEL = "struct<label_start:int,match_end:int,label:string,separator:string>"
_STACKED_KEYS = sorted({fold_text(w) for w in fixed.STACKED_LABELS + fixed.MULTILINGUAL_WORDS})


_STOP = 0
_LATE_RULES = tuple(r for r in fixed.ENGLISH_RULES if r.test == "person" or "company" in r.words)
_EARLY_RULES = tuple(r for r in fixed.ENGLISH_RULES if r not in _LATE_RULES)


def label_rule(label: Column, value: Column) -> Column:
    """Number (from 1) of the first rule for a label, null if there is none.

    Rules that look at the value come in the same order; a passport label whose value is no
    passport number ends the search without a rule. Three pattern tests decide which group of
    rules can match at all, so most labels are tested against few rules.
    """

    employee_value = value.contains("-") & value.rlike(EMPLOYEE_VALUE)

    def test(rule: fixed.LabelRule, folded: Column, plain: Column) -> Column:
        if rule in fixed.MULTILINGUAL_RULES:
            return contains_any(folded, [fold_text(w) for w in rule.words])
        if rule.test == "equals":
            return plain.isin(*rule.words)
        if rule.test == "handle":
            return plain.isin(*rule.words) & handle_value(value)
        if rule.test == "employee":
            return contains_any(plain, rule.words) | employee_value
        if rule.test == "person":
            return (
                contains_any(plain, rule.words)
                & ~contains_any(plain, fixed.NOT_A_PERSON_LABEL)
                & ~contains_any(F.lower(value), fixed.NOT_A_PERSON_VALUE)
            )
        return contains_any(plain, rule.words)

    def first(rules: tuple, folded: Column, plain: Column) -> Column:
        chosen = None
        for rule in rules:
            number = F.lit(LABEL_RULES.index(rule) + 1)
            if rule.test == "passport":
                number = F.when(value.rlike(PASSPORT_VALUE), number).otherwise(_STOP)
            found = test(rule, folded, plain)
            chosen = F.when(found, number) if chosen is None else chosen.when(found, number)
        return chosen

    def choose(keys: Column) -> Column:
        folded, plain = keys["folded"], keys["plain"]
        foreign = contains_any(folded, [fold_text(w) for w in fixed.MULTILINGUAL_WORDS])
        early = contains_any(plain, [w for r in _EARLY_RULES for w in r.words]) | employee_value
        number = F.when(foreign, first(fixed.MULTILINGUAL_RULES, folded, plain)).otherwise(
            F.coalesce(F.when(early, first(_EARLY_RULES, folded, plain)), first(_LATE_RULES, folded, plain))
        )
        return F.nullif(number, F.lit(_STOP))

    def with_folded(plain: Column) -> Column:  # of an ASCII label both forms are the same
        return let(F.struct(F.when(is_wide(label), fold(label)).otherwise(plain).alias("folded"), plain.alias("plain")), choose)

    return let(F.lower(clean_label(label)), with_folded)


def _rules() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.signal_type).alias("type"),
                F.lit(r.detector).alias("detector"),
                F.lit(r.marker).alias("marker"),
                F.lit(r.confidence).alias("confidence"),
            )
            for r in LABEL_RULES
        ]
    )


def _label_signals(spans: Column, line_number: Column, stacked: bool = False) -> Column:
    """array<struct<label,start,end,value,rule>> to signals; spans without a rule fall away."""

    def signal(span: Column) -> Column:
        def build(rule: Column) -> Column:
            detector, confidence = rule["detector"], rule["confidence"]
            if stacked:
                detector = F.concat(detector, F.lit("_stacked"))
                confidence = F.greatest(F.lit(0.0), confidence - F.lit(0.02))
            return F.struct(
                rule["type"].alias("type"),
                detector.alias("detector"),
                confidence.alias("confidence"),
                F.substring(
                    F.concat(span["label"], F.lit(": "), rule["marker"]), 1, fixed.SNIPPET_CHARS
                ).alias("snippet"),
                span["start"].alias("start"),
                span["end"].alias("end"),
                (span["line_number"] if stacked else line_number).alias("line_number"),
            )

        return let(F.element_at(_rules(), span["rule"]), build)

    return F.transform(F.filter(spans, lambda s: s["rule"].isNotNull()), signal)


def _with_rule(label: Column, start: Column, end: Column, value: Column, *more: Column) -> Column:
    return F.struct(
        label.alias("label"),
        start.alias("start"),
        end.alias("end"),
        F.when(filled_value(value), label_rule(label, value)).alias("rule"),
        *more,
    )


def _pass(line: Column, regex: str, groups: int, ascii_regex: str | None = None) -> Column:
    """Matches of one label pass with their cleaned label, before any overlap test."""
    fields = FIELD.join(f"${g}" for g in range(1, groups + 1))
    pieces = F.split(replaced(line, regex, ascii_regex, MARK + fields + MARK), MARK, -1)

    def labels(parts: Column) -> Column:
        marks = F.lit(groups - 1)
        lengths = F.transform(
            parts, lambda p, i: F.length(p) - F.when(i % 2 == 1, marks).otherwise(F.lit(0))
        )

        def located(starts: Column) -> Column:
            def one(i: Column) -> Column:
                fields_of = F.split(parts[i], FIELD, -1)
                separator = fields_of[2] if groups > 1 else F.lit("")
                inside_word = F.right(parts[i - 1], F.lit(1)).rlike("[A-Za-z0-9_]") & parts[i].rlike(
                    r"\A[A-Za-z0-9_]"
                )
                label = clean_label(fields_of[0])
                allowed = ~inside_word
                if groups > 1:
                    allowed = allowed & (
                        (separator != "=") | F.lower(label).isin(*fixed.EQUALS_LABELS)
                    )
                return F.when(
                    allowed,
                    F.struct(
                        starts[i].alias("label_start"),
                        (starts[i] + F.length(parts[i]) - marks).alias("match_end"),
                        label.alias("label"),
                        separator.alias("separator"),
                    ),
                )

            each = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)
            return F.filter(each, lambda m: m.isNotNull())

        return F.when(F.size(parts) < 3, empty(_LABEL)).otherwise(
            let(running_starts(lengths), located)
        )

    return let(pieces, labels)


def _not_overlapping(candidates: Column, taken: Column) -> Column:
    return F.filter(
        candidates,
        lambda c: ~F.exists(
            taken,
            lambda t: (t["label_start"] < c["match_end"]) & (c["label_start"] < t["match_end"]),
        ),
    )


def inline_labels(line: Column) -> Column:
    """Labels of a line in order: with a separator, then before white space, then bare."""
    separated = line.rlike("[:#=-]") | (is_wide(line) & line.rlike(_SEPARATOR))
    explicit = F.when(separated, _pass(line, _EXPLICIT, 4, _EXPLICIT_ASCII)).otherwise(empty(_LABEL))
    other_scripts = F.when(is_wide(line), line.rlike(f"{_PASSPORT}|{_CJK_ARABIC}")).otherwise(line.rlike(_PASSPORT))

    def add_blank(taken: Column) -> Column:
        return F.concat(taken, _not_overlapping(_pass(line, _BLANK, 1), taken))

    def add_bare(taken: Column) -> Column:
        return F.concat(taken, _not_overlapping(_pass(line, _BARE, 1), taken))

    return let(
        explicit,
        lambda e: F.array_sort(F.when(other_scripts, let(add_blank(e), add_bare)).otherwise(e)),
    )


def inline_values(line: Column) -> Column:
    """array<struct<label,start,end,value>>: each value runs to the next label of the line."""

    def values(labels: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(labels, i + 1)["label_start"], F.length(line))
            raw = F.substring(line, m["match_end"] + 1, stop - m["match_end"])
            left = F.ltrim(raw, F.lit(BLANKS))
            bare = trim_blanks(raw)
            value = F.when(m["separator"] == "=", _equals_value(bare)).otherwise(bare)
            start = m["match_end"] + F.length(raw) - F.length(left)
            return let(
                F.rtrim(F.rtrim(value, F.lit(" \t;,|")), F.lit(BLANKS)),
                lambda v: F.struct(
                    m["label"].alias("label"),
                    start.alias("start"),
                    (start + F.length(v)).alias("end"),
                    v.alias("value"),
                ),
            )

        return F.filter(F.transform(labels, one), lambda s: s["start"] < s["end"])

    return let(inline_labels(line), values)


def _equals_value(value: Column) -> Column:
    """After an equals sign: a quoted string, or everything up to white space or a delimiter."""
    quoted = F.regexp_extract(value, "\\A(?:'[^']*'|\"[^\"]*\")", 0)
    return F.when(quoted != "", quoted).otherwise(
        F.regexp_extract(value, f"\\A[^{SPACE};,|]*", 0)
    )


def label_line(line: Column) -> Column:
    """The whole line as one `label: value`, as an array of no or one span."""
    pattern = "\\A([{0}]*)([^{1}]{{1,72}})([{0}]*[{1}][{0}]*)([^\\n]+)\\z"
    cut = replaced(line, pattern.format(SPACE, ":："), pattern.format(ASCII_SPACE, ":"), FIELD.join(("$1", "$2", "$3", "$4")))

    def span(p: Column) -> Column:
        start = F.length(p[0]) + F.length(p[1]) + F.length(p[2])
        return let(
            F.rtrim(p[3], F.lit(BLANKS)),
            lambda value: F.when(
                value != "",
                F.array(
                    F.struct(
                        clean_label(p[1]).alias("label"),
                        start.alias("start"),
                        (start + F.length(value)).alias("end"),
                        value.alias("value"),
                    )
                ),
            ).otherwise(none),
        )

    none = empty("struct<label:string,start:int,end:int,value:string>")
    return let(F.split(cut, FIELD, -1), lambda parts: F.when(F.size(parts) == 4, span(parts)).otherwise(none))


def _signals_of(spans: Column, line: Column) -> Column:
    ruled = F.transform(
        spans,
        lambda s: _with_rule(s["label"], s["start"] + line["start"], s["end"] + line["start"], s["value"]),
    )
    return _label_signals(ruled, line["line_number"])


def whole_line_signals(line: Column) -> Column:
    """Signals of a line read as one label and value, for lines without an inline signal."""
    text = line["line"]
    whole = F.when(text.rlike("[:：]"), _signals_of(label_line(text), line)).otherwise(empty(SIGNAL))
    inline = _signals_of(inline_values(text), line)
    return F.when(F.size(inline) == 0, whole).otherwise(empty(SIGNAL))


def classified(label: Column, value: Column) -> Column:
    """The rule of a label with a filled value: struct<type,detector,marker,confidence>, or null."""
    return F.get(_rules(), F.when(filled_value(value), label_rule(label, value)) - 1)


def line_signals(line: Column) -> Column:
    """Signals of one line struct: inline labels, else the whole line as label and value."""
    text = line["line"]
    colon = text.contains(":") | text.contains("：")
    whole = F.when(colon, _signals_of(label_line(text), line)).otherwise(empty(SIGNAL))
    return let(
        _signals_of(inline_values(text), line),
        lambda found: F.when(F.size(found) > 0, found).otherwise(whole),
    )


def may_have_label(text: Column, its_signs: Column | None = None) -> Column:
    """Whether a line, or any line of a text, can hold a label. Where the `signs` of the text are known, its marks are looked for there."""
    told = text if its_signs is None else its_signs
    return told.rlike(_MARKS) | (is_wide(told) & told.rlike(_WIDE_MARKS)) | text.rlike(_PASSPORT)


def label_signals(lines: Column) -> Column:
    """All label signals of a document, in line order."""
    worth_reading = F.filter(lines, lambda ln: may_have_label(ln["line"]))
    return F.flatten(F.transform(worth_reading, line_signals))


def stacked_label(line: Column) -> Column:
    """The label a line consists of, null if it is no known label."""
    bare = trim_blanks(F.rtrim(trim_blanks(line), F.lit(":：#=-–—")))

    def known(label: Column) -> Column:
        return F.when(
            (label != "")
            & (F.length(label) <= 72)
            & ~label.rlike(r"[\p{N}/\\|{}\[\]()]")
            & (F.size(F.split(label, f"[{SPACE}]+")) <= 6)
            & fold(label).isin(*_STACKED_KEYS),
            clean_label(label),
        )

    few_words = F.when(is_wide(line), line.rlike(_FEW_WORDS)).otherwise(line.rlike(_FEW_ASCII_WORDS))
    return F.when(few_words, let(bare, known)).otherwise(F.lit(None).cast("string"))


def stacked_values(lines: Column) -> Column:
    """array<struct<label,start,end,value,line_number>>: a label line takes the next non-empty of
    the three lines below it, unless that is a label line too."""

    def with_labels(labels: Column) -> Column:
        def one(i: Column) -> Column:
            below = F.slice(lines, i + 2, F.lit(3))
            first = F.get(F.filter(below, lambda b: trim_blanks(b["line"]) != ""), F.lit(0))

            def span(v: Column) -> Column:
                value = trim_blanks(v["line"])
                start = v["start"] + F.length(v["line"]) - F.length(F.ltrim(v["line"], F.lit(BLANKS)))
                return F.when(
                    v.isNotNull() & stacked_label(v["line"]).isNull(),
                    F.struct(
                        labels[i].alias("label"),
                        start.alias("start"),
                        (start + F.length(value)).alias("end"),
                        value.alias("value"),
                        v["line_number"].alias("line_number"),
                    ),
                )

            return let(first, span)

        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: labels[i].isNotNull())
        return F.filter(F.transform(at, one), lambda s: s.isNotNull())

    return F.when(
        F.size(lines) < 2,
        empty("struct<label:string,start:int,end:int,value:string,line_number:int>"),
    ).otherwise(let(F.transform(lines, lambda ln: stacked_label(ln["line"])), with_labels))


def stacked_signals(lines: Column) -> Column:
    """All stacked-label signals of a document, in the order of their labels."""
    ruled = F.transform(
        stacked_values(lines),
        lambda s: _with_rule(
            s["label"], s["start"], s["end"], s["value"], s["line_number"].alias("line_number")
        ),
    )
    found = _label_signals(ruled, F.lit(None), stacked=True)
    return F.filter(found, lambda s: s["type"].isin(*fixed.STACKED_TYPES))
