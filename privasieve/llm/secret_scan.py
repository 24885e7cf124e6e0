"""Secrets by patterns and by character Markov models, with built-in functions only.

Base spans follow fixed patterns (`BASE_KINDS`). Two first-order Markov models of characters are trained from labelled
samples, one of random strings (the values in base spans), one of ordinary identifiers (long words of the corpus). Any
further token of `LEAST_TOKEN` characters or more is a secret if the log-likelihood ratio of the two models says so.
All documents are counted; only the counts of character pairs (a bounded table) reach the driver. The text is read inside
its row and never shuffled.

Null texts count as empty and have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, match_spans
from .pii import prepared, where
from .shared import settle

BASE_KINDS = ("assign", "access", "hex")
ADDED_KIND = "random"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_TOKEN = 20
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}+"
IDENTIFIER = "[A-Za-z_]{12,}+"
LEAST_RATIO = 7.0  # log of the prior odds against a secret, about a thousand to one
UNIFORM = 0.5  # share of the random model that stands for strings over all letters


def spans_of(text: Column) -> Column:
    """array<struct<start,place,end,kind,value>> of base spans (place 0 to 2) and further tokens (place 3), by start."""

    def of_kind(place: int, kind: str, spans: Column, value=lambda v: v) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), value(s["value"]).alias("value")
        ))

    assign = F.filter(
        of_kind(0, "assign", where(text.rlike(ASSIGN), match_spans(text, ASSIGN)), lambda v: F.regexp_extract(v, ASSIGN, 2)), lambda s: F.length(s["value"]) >= 6
    )
    access = of_kind(1, "access", where(text.contains("AKIA"), match_spans(text, ACCESS)))
    hexes = of_kind(2, "hex", where(text.rlike("[0-9a-f]{24}"), match_spans(text, HEX)))
    tokens = of_kind(3, ADDED_KIND, where(text.rlike(f"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN}}}"), match_spans(text, TOKEN)))

    def with_free(base: Column) -> Column:
        free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.array_sort(F.concat(base, free))

    return let(F.concat(assign, access, hexes), with_free)


def pairs(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(2)))


def pair_counts(values: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring letters stands in the strings of the column `value`."""
    exploded = values.filter(F.length("value") > 1).select(F.explode(pairs(F.col("value"))).alias("pair"))
    return {r["pair"]: r["count"] for r in exploded.groupBy("pair").count().collect() if r["pair"][0] in LETTERS and r["pair"][1] in LETTERS}


def ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """log P(b|a) under the random model less that under the ordinary one, for all pairs of letters in order."""
    n = len(LETTERS)
    out = []
    for a in LETTERS:
        r, o = (sum(counts.get(a + b, 0) for b in LETTERS) for counts in (random, ordinary))
        for b in LETTERS:
            p = UNIFORM / n + (1 - UNIFORM) * (random.get(a + b, 0) + 1 / n) / (r + 1)
            q = (ordinary.get(a + b, 0) + 0.1) / (o + 0.1 * n)
            out.append(math.log(p / q))
    return out


def train(found: DataFrame, docs: DataFrame, text_column: str = "text") -> list[float]:
    """The table of ratios. `found`: rows of `scan`; `docs`: the same documents."""
    samples = found.select(F.explode("found").alias("s")).filter(F.col("s.place") < 3).select(F.col("s.value").alias("value"))
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    return ratios(pair_counts(samples), pair_counts(words))


def likelihood_ratio(value: Column, table: list[float]) -> Column:
    """Sum of the table's entries over the neighbouring letters of a token."""
    logs = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in table) + "]"), "array<double>")
    place = lambda i: F.instr(F.lit(LETTERS), F.substring(value, i, F.lit(1))) - 1
    entries = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.get(logs, place(i) * len(LETTERS) + place(i + 1)))
    return F.aggregate(entries, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and found spans of every row, kept in the shared folder (of the text it holds only the values)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), prepared(F.col(text_column)).alias("text"))
    return settle(rows.select("doc_id", spans_of(F.col("text")).alias("found")))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<start,place,end,kind,value>> by start and kind. One row per row."""
    found = scan(docs, id_column, text_column)
    table = train(found, docs, text_column)
    secret = lambda s: (s["place"] < 3) | (likelihood_ratio(s["value"], table) >= LEAST_RATIO)
    return found.select("doc_id", F.filter("found", secret).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the digest of their list, and all spans."""
    base = F.filter("spans", lambda s: s["place"] < 3)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
