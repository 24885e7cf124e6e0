"""Value checks behind the detection rules, as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import SPACE, contains_any, java_regex, let, strip, trim_blanks

_DIGITS = [chr(c) for c in range(0x660, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

DATE_LIKE = java_regex(f"^{fixed.DATE_LIKE}$")
SSN_ONLY = java_regex(r"^\d{3}-\d{2}-\d{4}$")
PASSPORT_VALUE = java_regex(fixed.PASSPORT_VALUE, ignore_case=True)
EMPLOYEE_VALUE = java_regex(fixed.EMPLOYEE_ID, ignore_case=True)

ASCII_RUN = r"0-9 \-().+"


def digits(value: Column) -> Column:
    """Only the decimal digits, in any script, as ASCII digits."""
    return F.translate(F.regexp_replace(value, r"[^\p{Nd}]", ""), "".join(_DIGITS), _DIGIT_VALUES)


def valid_card(value: Column) -> Column:
    return let(
        digits(value),
        lambda d: F.length(d).between(13, 19)
        & ~d.rlike(r"\A(.)\1*\z")
        & F.call_function("luhn_check", d),
    )


def valid_phone(value: Column) -> Column:
    plain = strip(value)
    return (
        F.length(digits(value)).between(7, 15)
        & ~plain.rlike(DATE_LIKE)
        & ~plain.rlike(SSN_ONLY)
        & ~valid_card(value)
    )


def valid_ipv4(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda part: digits(part).cast("int") <= 255)


def personal_url(value: Column) -> Column:
    return contains_any(F.lower(value), fixed.URL_HINTS)


def around(text: Column, start: Column, end: Column, chars: int) -> Column:
    """The text from `chars` before a span to `chars` after it."""
    first = F.greatest(start - chars, F.lit(0))
    return F.substring(text, first + 1, end + chars - first)


def phone_run_ok(piece: Column, start: Column, end: Column) -> Column:
    """A phone number inside a longer run of digits is one only if the whole run could be one."""
    before = F.regexp_extract(F.substring(piece, F.lit(1), start), f"[{ASCII_RUN}]*\\z", 0)
    value = F.substring(piece, start + 1, end - start)
    after = F.regexp_extract(F.substring(piece, end + 1, F.length(piece)), f"\\A[{ASCII_RUN}]*", 0)
    return let(
        F.concat(before, value, after),
        lambda run: (F.length(digits(run)) <= 15) & ~valid_card(run),
    )


def phone_context_ok(text: Column, start: Column, end: Column, value: Column) -> Column:
    """A bare digit string needs a phone word near it; a formatted one does not."""
    near = F.lower(around(text, start, end, fixed.PHONE_CONTEXT_CHARS))
    return F.when(value.rlike(r"[+ \-().]"), F.lit(True)).otherwise(
        let(near, lambda n: contains_any(n, fixed.PHONE_WORDS))
    )


def amount_context_ok(text: Column, start: Column, end: Column) -> Column:
    return contains_any(
        F.lower(around(text, start, end, fixed.AMOUNT_CONTEXT_CHARS)), fixed.AMOUNT_WORDS
    )


def filled_value(value: Column) -> Column:
    """A form value that says something: not blank, not punctuation, not a placeholder word."""

    def says_something(plain: Column) -> Column:
        word = F.lower(F.btrim(plain, F.lit(" _.-/")))
        return (F.length(plain) >= 2) & plain.rlike(r"[\p{L}\p{N}]") & ~word.isin(*fixed.PLACEHOLDER_VALUES)

    return let(trim_blanks(value), says_something)


def handle_value(value: Column) -> Column:
    plain = F.regexp_replace(strip(value), "\\A['\"]+|['\"]+\\z", "")
    return (
        F.length(plain).between(3, 64)
        & ~plain.rlike(f"[{SPACE}]")
        & (plain.contains("@") | plain.rlike(f"\\A{fixed.HANDLE_VALUE}\\z"))
    )

