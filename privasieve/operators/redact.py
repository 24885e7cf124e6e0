"""Redacted context around signals, and masking of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import SPACE, cutter, empty, java_regex, let, preceding, replaced, running_max, running_starts, searchable, short_hash, strip
from .anchors import anchor_id, marker_of
from .detect import hold

MARGIN, MAX_CONTEXT = 90, 260
_TO_SCRUB = r"[@:：\p{Nd}]"  # a text without any of these holds nothing to scrub

# Raw values that may not appear in any output.
LEAK_PATTERNS = (
    fixed.EMAIL,
    r"https?://",
    r"/Users/[^\"\s]+",
    r"/srv/[^/\"\s]+/(?:sources|data)/[^\"\s]+",
    r"\b(?:access_token|refresh_token|Bearer)\b",
)
AUDIT_MASKS = (
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[redacted-email]"),
    (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", "[redacted-iban]"),
    (r"\b(?:\+?\d[\s-]?){9,}\b", "[redacted-number]"),
)


def scrub_labels(text: Column) -> Column:
    """`label: value` pieces between ; , | and tab lose their value unless it is a marker."""

    def piece(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?s)\A([^:：]*[:：])(.*)\z", 1)
        value = strip(F.regexp_extract(p, r"(?s)\A([^:：]*[:：])(.*)\z", 2))
        keep = (head == "") | (value == "") | value.startswith("[REDACTED_")
        return F.when(keep, p).otherwise(F.concat(head, F.lit(" [REDACTED_CONTEXT]")))

    pieces = F.split(text, r"(?<=[;,|\t])|(?=[;,|\t])", -1)
    # A text without a colon stays as it is, and a split by a longer pattern would read that pattern anew for every text.
    return F.when(text.contains(":") | text.contains("："), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def scrub_numbers(text: Column) -> Column:
    """Mail addresses, phone numbers and long digit runs of neighbour text, in this order."""

    def by_marker(found: Column, pattern: str, marker: str) -> Column:
        return replaced(found, java_regex(pattern), java_regex(pattern, only_ascii=True), marker)

    mailed = F.when(text.contains("@"), by_marker(text, fixed.EMAIL, "[REDACTED_EMAIL]")).otherwise(text)

    def numbered(out: Column) -> Column:  # both patterns hold two digits at least
        phoned = by_marker(out, fixed.PHONE, "[REDACTED_PHONE]")
        return F.when(out.rlike(r"\p{Nd}"), let(phoned, lambda p: by_marker(p, fixed.LONG_DIGITS, "[REDACTED_NUMBER]"))).otherwise(out)

    return let(mailed, numbered)


def scrub_plain(text: Column) -> Column:
    return F.when(text.rlike(_TO_SCRUB), let(scrub_numbers(text), scrub_labels)).otherwise(text)


def _bounds(low: Column, high: Column, start: Column, end: Column) -> Column:
    """struct<first,last>: some text on both sides of a span, inside its line from `low` to `high`."""
    first = F.greatest(low, start - MARGIN)
    last = F.least(high, end + MARGIN)
    middle = F.floor((start + end) / 2).cast("int")
    from_middle = F.greatest(low, middle - MAX_CONTEXT // 2)
    last_of_middle = F.least(high, from_middle + MAX_CONTEXT)
    narrow = F.struct(F.greatest(low, last_of_middle - MAX_CONTEXT).alias("first"), last_of_middle.alias("last"))
    wide = F.struct(first.alias("first"), last.alias("last"))
    return F.when(last - first > MAX_CONTEXT, narrow).otherwise(wide)


def context_bounds(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per span to mask with the bounds of its context; no text is masked."""
    text = F.col("text")
    feeds = running_starts(F.transform(F.split(searchable(text), "\n", -1), lambda p: F.length(p) + 1))
    spans = hold(hold(documents.select(key, "text", "signals"), "_spans", signal_spans(text, F.col("signals"))), "_lines", feeds)
    starts, ends = (F.transform("_spans", lambda s: s[f]) for f in ("start", "end"))
    found = hold(hold(spans, "_at", preceding(F.col("_lines"), starts)), "_until", preceding(F.col("_lines"), ends))

    def one(s: Column, i: Column) -> Column:
        high = F.coalesce(F.get("_lines", F.get("_until", i) + 1) - 1, F.length(text))
        return F.struct(s["anchor_id"].alias("anchor_id"), _bounds(F.get("_lines", F.get("_at", i)), high, s["start"], s["end"]).alias("b"))

    return found.select(key, F.inline(F.transform("_spans", one))).select(
        key, "anchor_id", F.col("b.first").alias("context_start"), F.col("b.last").alias("context_end")
    )


def signal_spans(text: Column, signals: Column) -> Column:
    """Spans to mask, by position: array<struct<start,end,anchor_id,marker>>."""
    spans = F.transform(
        signals,
        lambda s: F.struct(
            F.least(s["start"], F.length(text)).alias("start"),
            F.least(s["end"], F.length(text)).alias("end"),
            anchor_id(s["type"], s["detector"], s["start"], s["end"]).alias("anchor_id"),
            marker_of(s["snippet"]).alias("marker"),
        ),
    )
    return F.array_sort(F.filter(spans, lambda s: s["start"] < s["end"]))


def _masked(text: Column, first: Column, last: Column, spans: Column, target: Column, scrub) -> Column:
    """Text between two offsets with spans replaced by markers and the rest scrubbed."""

    def cut(a: Column, b: Column) -> Column:
        return F.when(a < b, scrub(F.substring(text, a + 1, b - a))).otherwise("")

    def step(acc: Column, span: Column) -> Column:
        begin, stop = F.greatest(first, span["start"]), F.least(last, span["end"])

        def add(out: Column) -> Column:
            hit = span["anchor_id"] == target
            return F.struct(
                stop.alias("cursor"),
                F.concat(out, span["marker"]).alias("out"),
                F.when(hit, F.length(out)).otherwise(acc["mark_start"]).alias("mark_start"),
                F.when(hit, F.length(out) + F.length(span["marker"])).otherwise(acc["mark_end"]).alias("mark_end"),
            )

        grown = let(F.concat(acc["out"], cut(acc["cursor"], begin)), add)
        return F.when(stop <= acc["cursor"], acc).otherwise(grown)

    zero = F.struct(
        first.cast("int").alias("cursor"), F.lit("").alias("out"),
        F.lit(0).alias("mark_start"), F.lit(0).alias("mark_end"),
    )
    return F.aggregate(
        spans, zero, step,
        lambda acc: F.struct(
            F.concat(acc["out"], cut(acc["cursor"], last)).alias("text"),
            acc["mark_start"].alias("mark_start"), acc["mark_end"].alias("mark_end"),
        ),
    )


WINDOW = "struct<anchor_id:string,marker:string,first:int,last:int,text:string,mark_start:int,mark_end:int>"


def windows_of(text: Column, signals: Column) -> Column:
    """Around every span to mask its bounds, its masked context and the marker's place there: one array of WINDOW.

    Lines and spans near a signal are found by merging positions inside the row, and contexts are cut from stretches of the
    text, so time follows the text and its signals, not their product.
    """

    def merged(spans: Column) -> Column:
        starts, ends = (F.transform(spans, lambda s: s[f]) for f in ("start", "end"))
        feeds = running_starts(F.transform(F.split(searchable(text), "\n", -1), lambda p: F.length(p) + 1))

        def bounded(lines: Column) -> Column:
            def one(at: Column, until: Column) -> Column:
                def bounds(s: Column, i: Column) -> Column:
                    following = F.get(lines, F.get(until, i) + 1)
                    low, high = F.get(lines, F.get(at, i)), F.coalesce(following - 1, F.length(text))
                    return _bounds(low, high, s["start"], s["end"])

                return F.transform(spans, bounds)

            return let(preceding(lines, starts), lambda at: let(preceding(lines, ends), lambda until: one(at, until)))

        def shown(bounds: Column) -> Column:
            reach = running_max(ends, F.lit(0))  # of the spans before each: ascending

            def near(low: Column, high: Column) -> Column:
                def window(s: Column, i: Column, cut) -> Column:
                    b = F.get(bounds, i)
                    # Spans before the first whose reach goes beyond the window's start end before it.
                    from_span = F.greatest(F.get(low, i), F.lit(0))
                    some = F.slice(spans, from_span + 1, F.greatest(F.get(high, i) - from_span + 1, F.lit(0)))
                    some = F.filter(some, lambda x: (x["start"] < b["last"]) & (b["first"] < x["end"]))
                    moved = F.transform(some, lambda x: x.withField("start", x["start"] - b["first"]).withField("end", x["end"] - b["first"]))
                    own = F.struct(cut(b["first"], b["last"]).alias("context"), moved.alias("near"), b.alias("b"))

                    def masked(o: Column) -> Column:
                        m = _masked(o["context"], F.lit(0), o["b"]["last"] - o["b"]["first"], o["near"], s["anchor_id"], scrub_plain)
                        return let(m, lambda x: F.struct(
                            s["anchor_id"].alias("anchor_id"), s["marker"].alias("marker"), o["b"]["first"].alias("first"), o["b"]["last"].alias("last"),
                            x["text"].alias("text"), x["mark_start"].alias("mark_start"), x["mark_end"].alias("mark_end")))

                    return let(own, masked)

                return cutter(text, lambda cut: F.transform(spans, lambda s, i: window(s, i, cut)))

            firsts = F.transform(bounds, lambda b: b["first"])
            lasts = F.transform(bounds, lambda b: b["last"] - 1)
            return let(let(reach, lambda r: preceding(r, firsts)), lambda low: let(preceding(starts, lasts), lambda high: near(low, high)))

        return let(let(feeds, bounded), shown)

    return let(signal_spans(text, signals), lambda spans: F.when(F.size(spans) == 0, empty(WINDOW)).otherwise(merged(spans)))


def context_windows(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per signal: bounds, redacted context and highlight. Needs `text` and `signals`."""
    found = hold(documents.select(key, "text", "signals"), "_windows", windows_of(F.col("text"), F.col("signals")))
    rows = found.select(key, F.inline("_windows"))
    shown = hold(rows, "shown", strip(F.col("text")))
    at = F.call_function("locate", F.col("marker"), F.col("shown"))
    missed = F.col("mark_end") == 0
    return shown.select(
        key,
        "anchor_id",
        F.col("first").alias("context_start"),
        F.col("last").alias("context_end"),
        F.col("shown").alias("redacted_context"),
        F.when(missed, F.greatest(at - 1, F.lit(0))).otherwise(F.col("mark_start")).alias("highlight_start"),
        F.when(missed & (at > 0), at - 1 + F.length("marker"))
        .when(missed, 0).otherwise(F.col("mark_end")).alias("highlight_end"),
    ).filter(F.col("redacted_context") != "")


def masked_text(text: Column, signals: Column) -> Column:
    """A whole text with every signal span masked and the rest scrubbed line by line.

    What stands before a span begins where the spans before it reach to, a running maximum; the kept stretches and the markers
    are pieces that are joined once.
    """

    def scrub(gap: Column) -> Column:
        return F.when(gap.rlike(_TO_SCRUB), F.array_join(F.transform(F.split(gap, "\n", -1), scrub_plain), "\n")).otherwise(gap)

    def joined(spans: Column, reach: Column) -> Column:
        def pieces(cut) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.get(reach, i)
                gap = F.when(before < s["start"], scrub(cut(before, s["start"]))).otherwise("")
                return F.when(s["end"] <= before, "").otherwise(F.concat(gap, s["marker"]))

            last = F.greatest(F.get(reach, F.size(spans) - 1), F.get(spans, F.size(spans) - 1)["end"])
            tail = F.when(last < F.length(text), scrub(cut(last, F.length(text)))).otherwise("")
            return F.array_join(F.concat(F.transform(spans, piece), F.array(tail)), "")

        return cutter(text, pieces)

    def masked(spans: Column) -> Column:
        reach = running_max(F.transform(spans, lambda s: s["end"]), F.lit(0))
        return F.when(F.size(spans) == 0, scrub(text)).otherwise(let(reach, lambda r: joined(spans, r)))

    return let(signal_spans(text, signals), masked)


def masked_documents(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole texts with every signal span masked and the rest scrubbed line by line."""
    return documents.select(key, masked_text(F.col("text"), F.col("signals")).alias("masked_text"))


def preview_packages(windows: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One review package per document: anchors in signal order, counts, and a preview id.

    `windows` has key, seq, anchor_id, selector_type. A document's anchors are bounded by its text.
    """
    anchors = F.array_sort(F.collect_list(F.struct("seq", "anchor_id", "selector_type")))
    packed = windows.groupBy(key).agg(anchors.alias("anchors"))
    ids = F.array_join(F.transform("anchors", lambda a: a["anchor_id"]), ",")

    def of_type(name: str) -> Column:
        return F.size(F.filter("anchors", lambda a: a["selector_type"] == name))

    return packed.join(files.select(key, "name", "file_format"), key).select(
        key,
        F.concat(F.lit("source_preview_"), short_hash(F.concat_ws(":", "name", "file_format", ids), 12)).alias("preview_id"),
        F.size("anchors").alias("anchors"),
        of_type("textPosition").alias("text_ranges"),
        of_type("tableCell").alias("table_cells"),
        of_type("structurePath").alias("structure_blocks"),
    )


def audit_text(text: Column) -> Column:
    """Free text for an audit record: one line, personal values masked."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), f"[{SPACE}]{{2,}}", " "))
    for pattern, mask in AUDIT_MASKS:
        out = F.regexp_replace(out, pattern, mask)
    return out


def leaks(frame: DataFrame) -> DataFrame:
    """Per raw-value pattern, how many rows of an output show one. All counts should be zero."""
    row = F.to_json(F.struct("*"))
    counts = frame.select(row.alias("row")).agg(
        *[F.count_if(F.col("row").rlike(java_regex(p))).alias(f"p{i}") for i, p in enumerate(LEAK_PATTERNS)]
    )
    pairs = F.array(*[F.struct(F.lit(i).alias("pattern"), F.col(f"p{i}").alias("rows")) for i in range(len(LEAK_PATTERNS))])
    return counts.select(F.inline(pairs))
