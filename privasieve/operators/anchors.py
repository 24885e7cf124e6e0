"""Evidence anchors: where a redacted signal sits in its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import display_type, empty, let, lines, preceding, running_max, running_starts, searchable, short_hash

SOURCE_REFERENCE = "source_reference:"
_MARKER = r"\[REDACTED_[A-Z0-9_]+\]"
# Fixed value: location labels that may be shown outside.
SAFE_LABEL = (
    r"\A(?:Line \d+|Page \d+|Image OCR text|Frame \d+ OCR text|Transcript text|"
    r"DOCX paragraph \d+|ODT paragraph \d+|Slide \d+ shape \d+|HTML [a-z0-9]+ \d+|"
    r"XML element [0-9.]+(?: attribute \d+)?|(?:JSON|JSONL|NDJSON)(?: record \d+)? field [0-9.]+|"
    r"Email (?:header|body part) \d+|ZIP member \d+(?:: [A-Za-z0-9_./:#\[\] -]{1,80})?|"
    r"row \d+ column [A-Z]+)\z"
)


def anchor_id(signal_type: Column, detector: Column, start: Column, end: Column) -> Column:
    key = F.concat_ws(":", signal_type, detector, start.cast("string"), end.cast("string"))
    return F.concat(F.lit("anchor_"), short_hash(key, 12))


def text_position_anchors(signals: DataFrame) -> DataFrame:
    """Signals with anchor id, label, redacted text and fallback label."""
    return signals.select(
        "*",
        anchor_id(F.col("type"), F.col("detector"), F.col("start"), F.col("end")).alias("anchor_id"),
        display_type(F.col("type")).alias("label"),
        F.substring("snippet", 1, fixed.SNIPPET_CHARS).alias("redacted_text"),
        F.concat(F.lit("Line "), F.col("line_number")).alias("fallback_label"),
    )


def all_line_starts(text: Column) -> Column:
    """Offsets of the lines of a text by line feeds; a feed at the end begins an empty last line."""
    return running_starts(F.transform(F.split(searchable(text), "\n", -1), lambda p: F.length(p) + 1))


def signal_line_numbers(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line number of each signal from the line feeds before it, merged in the document row; no text leaves it."""
    before = preceding(all_line_starts(F.col("text")), F.transform("signals", lambda s: s["start"]))
    held = documents.select(key, "signals", F.explode(F.array(before)).alias("before"))
    rows = F.transform("signals", lambda s, i: F.struct(s["start"].alias("start"), s["type"].alias("type"), (F.get("before", i) + 1).alias("line_at")))
    return held.select(key, F.inline(rows))


def signal_line_columns(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line and column of each signal, merged with the line starts in the document row."""
    held = documents.select(key, "signals", F.explode(F.array(line_starts(F.col("text")))).alias("starts"))
    held = held.select("*", F.explode(F.array(preceding(F.col("starts"), F.transform("signals", lambda s: s["start"])))).alias("at"))
    column = lambda s, i: F.greatest(s["start"] - F.get("starts", F.get("at", i)) + 1, F.lit(1))
    rows = F.transform("signals", lambda s, i: F.struct((i + 1).alias("seq"), (F.get("at", i) + 1).alias("line"), column(s, i).alias("column")))
    return held.select(key, F.inline(rows))


def located_in_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The line that holds each signal and where in it the signal lies: `located_signals` over the lines of a text."""
    places = F.transform(
        lines(searchable(F.col("text"))),
        lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["line"])).alias("end"), x["line_number"].cast("string").alias("path"),
            F.concat(F.lit("Line "), x["line_number"]).alias("label"),
        ),
    )
    held = documents.select(key, "signals", F.explode(F.array(places)).alias("places"))
    none = F.array().cast("array<int>")
    found = located_signals(F.col("signals"), F.col("places"), F.transform("places", lambda p: p["start"]), F.lit("text"), F.lit("textPosition"), F.lit(False), none)
    return held.select(key, F.inline(found)).withColumn("loc_ordinal", F.col("path").cast("int"))


BUCKET_CHARS = 4096


def _buckets(start: Column, end: Column) -> Column:
    """Numbers of the stretches of text that a span touches."""
    last = F.greatest(start, end - 1)
    return F.sequence((start / BUCKET_CHARS).cast("int"), (last / BUCKET_CHARS).cast("int"))


def locate(signals: DataFrame, locations: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first location (by ordinal) of the document that contains the signal, if any.

    Both sides meet by document and stretch of text, so a document with very many locations and
    signals compares only neighbours and can be spread over tasks. Signals without a location stay.
    """
    places = locations.withColumn("bucket", F.explode(_buckets(F.col("loc_start"), F.col("loc_end") + 1)))
    marked = signals.withColumn("bucket", (F.col("start") / BUCKET_CHARS).cast("int"))
    joined = marked.alias("s").join(
        places.alias("l"),
        (F.col(f"s.{key}") == F.col(f"l.{key}"))
        & (F.col("s.bucket") == F.col("l.bucket"))
        & (F.col("l.loc_start") <= F.col("s.start"))
        & (F.col("s.end") <= F.col("l.loc_end")),
        "left",
    ).select(*[F.col(f"s.{c}").alias(c) for c in signals.columns], "l.loc_ordinal", "l.loc_start", "l.loc_label")
    first = F.min_by(F.struct("loc_ordinal", "loc_start", "loc_label"), "loc_ordinal")
    return (
        joined.groupBy(*signals.columns).agg(first.alias("loc"))
        .select(
            *signals.columns,
            F.col("loc.loc_ordinal").alias("loc_ordinal"),
            F.col("loc.loc_label").alias("loc_label"),
            (F.col("start") - F.col("loc.loc_start")).alias("source_start"),
            (F.col("end") - F.col("loc.loc_start")).alias("source_end"),
        )
    )


def line_column(line_starts: Column, position: Column, base_line: Column, base_column: Column) -> Column:
    """Line and column of a position from the starts of its lines (one position; for many see `located_signals`)."""

    def build(at: Column) -> Column:
        column = F.greatest(position - F.element_at(line_starts, at) + 1, F.lit(1))
        return F.struct(
            (base_line + at - 1).cast("int").alias("line"),
            F.when(at == 1, base_column + column - 1).otherwise(column).cast("int").alias("column"),
        )

    at = F.greatest(F.lit(1), F.size(F.filter(line_starts, lambda s: s <= F.greatest(position, F.lit(0)))))
    return let(at, build)


def region_union(regions: DataFrame, signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bounding box of the page regions a signal overlaps, with the attributes of the first one.

    Joined like `locate`; a pair that shares several stretches counts in the one where its overlap begins.
    """
    marked = signals.withColumn("bucket", F.explode(_buckets(F.col("start"), F.col("end"))))
    boxes = regions.withColumn("bucket", F.explode(_buckets(F.col("region_start"), F.col("region_end"))))
    begins = (F.greatest(F.col("s.start"), F.col("r.region_start")) / BUCKET_CHARS).cast("int")
    joined = marked.alias("s").join(
        boxes.alias("r"),
        (F.col(f"s.{key}") == F.col(f"r.{key}"))
        & (F.col("s.bucket") == F.col("r.bucket"))
        & (F.col("s.bucket") == begins)
        & (F.col("r.region_start") < F.col("s.end"))
        & (F.col("s.start") < F.col("r.region_end")),
    )
    left, bottom = F.min("r.x"), F.min("r.y")
    return joined.groupBy(F.col(f"s.{key}").alias(key), F.col("s.seq").alias("seq")).agg(
        F.round(left, 2).alias("x"),
        F.round(bottom, 2).alias("y"),
        F.round(F.max(F.col("r.x") + F.col("r.width")) - left, 2).alias("width"),
        F.round(F.max(F.col("r.y") + F.col("r.height")) - bottom, 2).alias("height"),
        F.round(F.min("r.ocr_confidence"), 2).alias("ocr_confidence"),
        F.min_by("r.unit", "r.ordinal").alias("unit"),
        F.count("*").alias("regions"),
    )


def region_union_in_rows(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """`region_union` of documents that carry their `signals` and `regions` as arrays, with keys that do not repeat.

    Regions may overlap and come in any order. Sorted by start, those that a signal can overlap are a stretch between two
    positions, which one merge each finds for all signals, so no line and no region leaves its row.
    """
    spans = F.filter("regions", lambda r: r["region_start"].isNotNull() & r["region_end"].isNotNull())
    by_start = F.sort_array(F.transform(spans, lambda r: F.struct(r["region_start"].cast("int").alias("start"), r["region_end"].cast("int").alias("end"), r.alias("region"))))

    def told(signal: Column, i: Column, inside: Column) -> Column:
        def least(value: str) -> Column:
            return F.array_min(F.transform(inside, lambda r: r["region"][value]))

        def reach(begin: str, extent: str) -> Column:
            return F.round(F.array_max(F.transform(inside, lambda r: r["region"][begin] + r["region"][extent])) - least(begin), 2)

        first = F.array_min(F.transform(inside, lambda r: F.when(r["region"]["ordinal"].isNotNull(), F.struct(r["region"]["ordinal"].alias("ordinal"), r["region"]["unit"].alias("unit")))))
        return F.struct(
            (i + 1).alias("seq"), F.round(least("x"), 2).alias("x"), F.round(least("y"), 2).alias("y"),
            reach("x", "width").alias("width"), reach("y", "height").alias("height"),
            F.round(least("ocr_confidence"), 2).alias("ocr_confidence"), first["unit"].alias("unit"), F.size(inside).cast("long").alias("regions"),
        )

    def of_signals(places: Column, low: Column, high: Column) -> Column:
        def one(signal: Column, i: Column) -> Column:
            begin = F.get(low, i) + 1
            near = F.slice(places, begin + 1, F.greatest(F.get(high, i) - begin + 1, F.lit(0)))
            return let(F.filter(near, lambda r: r["end"] > signal["start"]), lambda inside: told(signal, i, inside))

        return F.filter(F.transform("signals", one), lambda x: x["regions"] > 0)

    def merged(places: Column) -> Column:
        ends = F.transform(places, lambda r: r["end"])
        reached = F.transform(F.arrays_zip(ends.alias("end"), running_max(ends, F.lit(0)).alias("before")), lambda x: F.greatest(x["end"], x["before"]))
        low = preceding(reached, F.transform("signals", lambda s: s["start"]))
        high = preceding(F.transform(places, lambda r: r["start"]), F.transform("signals", lambda s: s["end"] - 1))
        return let(low, lambda lows: let(high, lambda highs: of_signals(places, lows, highs)))

    return documents.select(key, F.inline(F.when(F.size("signals") > 0, let(by_start, merged))))


def marker_of(snippet: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(snippet, _MARKER, 0), F.lit("")), F.lit("[REDACTED_VALUE]")
    )


def public_snippet(signal_type: Column, snippet: Column) -> Column:
    """Type and marker only: no label text leaves the workspace."""
    text = F.concat_ws(": ", display_type(signal_type), marker_of(snippet))
    return F.substring(text, 1, fixed.SNIPPET_CHARS)


def safe_path(path: Column) -> Column:
    """Replace addresses and absolute paths by a reference that names nothing."""
    unsafe = (
        path.contains("://")
        | F.lower(path).startswith("www.")
        | path.startswith("/")
        | path.startswith("~/")
        | path.rlike(r"\A[A-Za-z]:[\\/]")
    )
    hidden = F.concat(F.lit(SOURCE_REFERENCE), short_hash(path, 12))
    return F.when(path.startswith(SOURCE_REFERENCE) | ~unsafe, path).otherwise(hidden)


def safe_label(label: Column) -> Column:
    plain = F.trim(label)
    return F.when(plain.rlike(SAFE_LABEL), plain).otherwise("Detected text")


def public_evidence(signals: DataFrame, key: str = "doc_id", top: int = 5) -> DataFrame:
    """All signals of each document as they may be shown; those after the first `top` are `beyond_top`. `seq` counts the signals
    of a document from 1, so it is their rank. A located signal is shown with the label of its place."""
    place = F.concat(F.lit("Line "), F.col("line_number")) if "line_number" in signals.columns else F.col("label")
    return signals.select(
        key, "seq", "type", "detector", F.round("confidence", 2).alias("confidence"),
        public_snippet(F.col("type"), F.col("snippet")).alias("snippet"),
        safe_label(F.coalesce(place, F.lit(""))).alias("location_label"),
        (F.col("seq") > top).alias("beyond_top"),
    )


LOCATED = (
    "struct<seq:int,type:string,detector:string,confidence:double,snippet:string,start:int,end:int,anchor_id:string,format:string,selector:string,"
    "path:string,label:string,page:int,line:int,column:int,source_start:int,source_end:int>"
)


def located_signals(
    signals: Column, locations: Column, starts_of_lines: Column, file_format: Column, selector: Column, line_of: Column, column_of: Column
) -> Column:
    """The signals of a document in the order of their positions, each with the place that holds it: one array of LOCATED.

    Signals, locations (spans by start that do not overlap) and line starts are merged by position inside the row, so a document
    with many of each costs little more than one with few, and nothing is shuffled. `line_of` and `column_of` tell where a
    location begins in its source (null: count lines and columns in the text itself). A signal that no location holds keeps its
    text position alone.
    """

    def merged(ordered: Column) -> Column:
        positions = F.transform(ordered, lambda s: s["start"])

        def told(at: Column, line_at: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                place = F.when(F.get(at, i) >= 0, F.get(locations, F.get(at, i)))
                inside = F.coalesce(s["start"] >= place["start"], F.lit(False)) & F.coalesce(s["end"] <= place["end"], F.lit(False))

                def within(x: Column) -> Column:
                    return F.when(inside, x)

                own_line = F.get(line_at, i)
                column = s["start"] - F.get(starts_of_lines, own_line) + 1
                return F.struct(
                    s["seq"].alias("seq"), s["signal"]["type"].alias("type"), s["signal"]["detector"].alias("detector"),
                    s["signal"]["confidence"].alias("confidence"), s["signal"]["snippet"].alias("snippet"), s["start"].alias("start"), s["end"].alias("end"),
                    anchor_id(s["signal"]["type"], s["signal"]["detector"], s["start"], s["end"]).alias("anchor_id"),
                    F.when(inside, file_format).otherwise("text").alias("format"), F.when(inside, selector).otherwise("textPosition").alias("selector"),
                    within(place["path"]).alias("path"),
                    within(place["label"]).alias("label"), F.lit(None).cast("int").alias("page"),
                    within(F.when(selector == "textPosition", F.coalesce(line_of_place(place), own_line + 1))).alias("line"),
                    within(F.when(selector == "textPosition", F.coalesce(column_of_place(place) + s["start"] - place["start"], column))).alias("column"),
                    within(s["start"] - place["start"]).alias("source_start"), within(s["end"] - place["start"]).alias("source_end"),
                )

            return F.transform(ordered, one)

        starts = F.transform(locations, lambda p: p["start"])
        return let(preceding(starts, positions), lambda at: let(preceding(starts_of_lines, positions), lambda line_at: told(at, line_at)))

    def line_of_place(place: Column) -> Column:
        return F.when(line_of, place["path"].try_cast("int"))

    def column_of_place(place: Column) -> Column:
        return F.when(line_of, F.get(column_of, place["path"].try_cast("int") - 1) + 1)

    numbered = F.transform(signals, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), (i + 1).alias("seq"), s.alias("signal")))
    return F.when(F.size(signals) == 0, empty(LOCATED)).otherwise(let(F.array_sort(numbered), merged)).cast(f"array<{LOCATED}>")


def text_lines_as_locations(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each line of a text as a location with its span."""
    return lines.select(
        key, F.col("line_number").alias("loc_ordinal"), F.col("start").alias("loc_start"),
        (F.col("start") + F.length("line")).alias("loc_end"),
        F.concat(F.lit("Line "), F.col("line_number")).alias("loc_label"),
    )


def line_starts(text: Column) -> Column:
    """Offsets of the lines of a text by line feeds, the last empty line left out."""
    parts = F.split(searchable(text), "\n", -1)
    lengths = F.transform(parts, lambda p: F.length(p) + 1)
    return F.filter(running_starts(lengths), lambda s: (s == 0) | (s < F.length(text)))
