"""From files of any text format to signals with their place in the source, as one lazy plan.

Name and content type choose a parser for each row; all parsers give the same array of fragments, whose joined text is searched
and whose places locate the signals. A file that cannot be read becomes a row of failures and stops nothing. All happens
inside the row: there is no exchange from the file to its signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty, searchable, strip
from ..operators import anchors, detect, extract, inventory

TABLES, STRUCTURES = ("csv", "tsv"), ("json", "jsonl", "ndjson", "xml", "html")
# Labels of texts without an inner structure.
STREAM_LABELS = {"video_transcript": "Transcript text", "sniffed": "Detected text content", "text": "Text content"}
UNREAD = ("pdf", "docx", "xlsx", "pptx", "xls", "ppt", "doc", "ods", "odp", "odt", "eml", "zip", "image_ocr", "video_ocr", "rtf", "unsupported")


def _stream(text: Column, label: str) -> Column:
    """A text without an inner structure is one fragment."""
    none = F.lit(None).cast("string")
    whole = F.struct(text.alias("text"), F.lit(0).alias("value_at"), none.alias("path"), F.lit(label).alias("label"), none.alias("label_path"), none.alias("label_label"))
    return F.when(strip(text) == "", empty(extract.FRAGMENT)).otherwise(F.array(whole))


def with_fragments(files: DataFrame, text: str = "text", name: str = "name", content_type: str = "content_type") -> DataFrame:
    """Add file_format, method, difficulty, fragments, extracted_text, issue and _indents.

    `issue` is null for files that were read, `unsupported` for formats without a parser here (their difficulty tells what they
    would take), `malformed`, or `no_text`.
    """
    kept = [F.col(c) for c in files.columns]
    known = detect.hold(files, "_format", inventory.classify(F.col(name), F.coalesce(F.col(content_type), F.lit(""))))
    fmt, body = F.col("_format.file_format"), F.coalesce(F.col(text), F.lit(""))
    sniffed = F.col("_format.method") == "sniffed_unicode_text"
    # Only Markdown files have lines to look through in the columns of the Markdown parser.
    prepared = known.withColumn("_markdown", F.when(fmt == "markdown", body).otherwise(""))
    prepared = extract.with_markdown(prepared, "_markdown", "_cells", "_indents")
    # Each parser gets the text only of files of its format.
    fragments = (
        F.when(fmt.isin(*UNREAD), F.lit(None))
        .when(fmt == "csv", extract.delimited(body)).when(fmt == "tsv", extract.delimited(body, tabs=True))
        .when(fmt == "json", extract.json_scalars(F.when(fmt == "json", body)))
        .when(fmt == "jsonl", extract.json_scalars(F.when(fmt == "jsonl", body), "jsonl"))
        .when(fmt == "ndjson", extract.json_scalars(F.when(fmt == "ndjson", body), "ndjson"))
        .when(fmt == "xml", extract.xml_scalars(body)).when(fmt == "html", extract.html_texts(body))
        .when(fmt == "markdown", F.col("_cells")).when(fmt == "video_transcript", _stream(extract.clean_transcript(body), STREAM_LABELS["video_transcript"]))
        .when(sniffed & ~inventory.looks_like_text(body), F.lit(None))
        .when(sniffed, _stream(body, STREAM_LABELS["sniffed"])).otherwise(_stream(body, STREAM_LABELS["text"]))
    )
    parsed = detect.hold(prepared, "fragments", fragments.cast(f"array<{extract.FRAGMENT}>"))
    joined = detect.hold(parsed, "extracted_text", extract.join_fragments(F.transform("fragments", lambda f: f["text"])))
    unread = fmt.isin(*UNREAD) | (sniffed & F.col("fragments").isNull())
    issue = (
        F.when(unread, "unsupported").when(F.col("fragments").isNull(), "malformed").when(strip(F.col("extracted_text")) == "", "no_text")
    )
    difficulty = F.when(F.col("fragments").isNull() & ~fmt.isin(*UNREAD), "unsupported").when(issue == "no_text", "hard").otherwise(F.col("_format.difficulty"))
    return joined.select(
        *kept, fmt.alias("file_format"), F.col("_format.method").alias("method"), difficulty.alias("difficulty"), "fragments", "extracted_text", issue.alias("issue"), "_indents"
    )


def selector_of(file_format: Column, path: Column) -> Column:
    """What kind of place a fragment is: a table cell, a place in a structure, or a position in a text."""
    cell = file_format.isin(*TABLES) | ((file_format == "markdown") & path.contains(","))
    return F.when(cell, "tableCell").when(file_format.isin(*STRUCTURES), "structurePath").otherwise("textPosition")


def scan_files(files: DataFrame, limits: detect.Limits = detect.Limits(), **columns: str) -> DataFrame:
    """The files with `located`: their signals with the place of each. Files with an issue have none."""
    read = with_fragments(files, **columns)
    found = detect.with_signals(read, "extracted_text", limits)
    placed = detect.hold(found, "_places", extract.locations(F.col("fragments")))
    markdown = F.col("file_format") == "markdown"
    lines_of = anchors.line_starts(searchable(F.col("extracted_text")))
    based = detect.hold(placed, "_line_starts", F.when(markdown, F.array(F.lit(0))).otherwise(lines_of))
    # The kind of place may differ between fragments of a Markdown file, so it is told for each signal.
    located = anchors.located_signals(
        F.col("signals"), F.col("_places"), F.col("_line_starts"), F.col("file_format"), F.lit("textPosition"), markdown, F.col("_indents")
    )
    told = detect.hold(based, "_located", F.when(F.col("issue").isNull(), located).otherwise(empty(anchors.LOCATED)))

    def tagged(s: Column) -> Column:
        kind = F.when(s["source_start"].isNull(), "textPosition").otherwise(selector_of(F.col("file_format"), s["path"]))
        plain = kind == "textPosition"
        return s.withField("selector", kind).withField("line", F.when(plain, s["line"])).withField("column", F.when(plain, s["column"])).withField(
            "path", F.when(~plain, s["path"])
        )

    kept = [c for c in told.columns if not c.startswith("_")]
    return told.select(*kept, F.transform("_located", tagged).alias("located"))


def signal_rows(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each located signal."""
    return scanned.select(key, F.col("file_format"), F.inline("located")).drop("format")


def failure_rows(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each file that could not be read."""
    return scanned.filter("issue IS NOT NULL").select(key, "file_format", "method", "issue", "difficulty")
