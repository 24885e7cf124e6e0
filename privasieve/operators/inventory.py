"""Reading sources: formats, size limits, file caps, decoding, and which sources may be scanned."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import SPACE, let

# Fixed values: (format, method, difficulty, suffixes, content types, content-type ending), tested in order.
FORMATS = (
    ("pdf", "pdf_text_layer", "moderate", (".pdf",), ("application/pdf",), ""),
    ("docx", "ooxml_docx_text", "moderate", (".docx",), (), "wordprocessingml.document"),
    ("xlsx", "ooxml_xlsx_text", "moderate", (".xlsx",), (), "spreadsheetml.sheet"),
    ("pptx", "ooxml_pptx_text", "moderate", (".pptx",), (), "presentationml.presentation"),
    ("xls", "libreoffice_legacy_office_text", "hard", (".xls",), ("application/vnd.ms-excel", "application/x-msexcel", "application/x-ms-excel"), ""),
    ("ppt", "libreoffice_legacy_office_text", "hard", (".ppt",), ("application/vnd.ms-powerpoint", "application/mspowerpoint", "application/powerpoint", "application/x-mspowerpoint"), ""),
    ("doc", "libreoffice_legacy_office_text", "hard", (".doc",), ("application/msword", "application/vnd.ms-office"), ""),
    ("ods", "odf_ods_text", "moderate", (".ods",), ("application/vnd.oasis.opendocument.spreadsheet",), ""),
    ("odp", "odf_odp_text", "moderate", (".odp",), ("application/vnd.oasis.opendocument.presentation",), ""),
    ("odt", "odf_odt_text", "moderate", (".odt",), ("application/vnd.oasis.opendocument.text",), ""),
    ("eml", "rfc5322_mime_text", "moderate", (".eml",), ("message/rfc822", "application/eml"), ""),
    ("zip", "zip_member_text", "moderate", (".zip",), ("application/zip", "application/x-zip-compressed"), ""),
    ("image_ocr", "tesseract_image_ocr", "hard", (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"),
     ("image/png", "image/jpeg", "image/tiff", "image/x-tiff", "image/bmp", "image/x-bmp", "image/x-ms-bmp", "image/webp"), ""),
    ("video_transcript", "utf8_video_transcript", "moderate", (".srt", ".vtt"), ("text/vtt", "application/x-subrip"), ""),
    ("video_ocr", "ffmpeg_frame_tesseract_ocr", "hard", (".mp4", ".mov", ".m4v", ".mkv", ".webm", ".avi"), (), "video/*"),
    ("tsv", "utf8_text", "easy", (".tsv",), ("text/tab-separated-values",), ""),
    ("csv", "utf8_text", "easy", (".csv",), ("text/csv",), ""),
    ("html", "html_text", "easy", (".html", ".htm"), ("text/html",), ""),
    ("markdown", "markdown_text", "easy", (".md",), ("text/markdown", "text/x-markdown"), ""),
    ("xml", "xml_structure_text", "easy", (".xml",), ("application/xml", "text/xml"), ""),
    ("rtf", "rtf_text", "moderate", (".rtf",), ("application/rtf", "text/rtf", "application/x-rtf"), ""),
    ("jsonl", "json_structure_text", "easy", (".jsonl",), (), ""),
    ("ndjson", "json_structure_text", "easy", (".ndjson",), ("application/x-ndjson",), ""),
    ("json", "json_structure_text", "easy", (".json",), ("application/json",), ""),
)
PLAIN_SUFFIXES = (".txt", ".log")
SNIFFED_TYPES = ("", "application/octet-stream", "binary/octet-stream")
VIDEO_SUFFIXES = (".mp4", ".mov", ".m4v", ".mkv", ".webm", ".avi")
COMPLEX_SUFFIXES = (
    ".pdf", ".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt", ".odt", ".ods", ".odp", ".eml", ".rtf", ".zip",
    ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp",
)
TEXT_BYTES, COMPLEX_BYTES, VIDEO_BYTES, SOURCE_FILES = 1_000_000, 8_000_000, 8_000_000, 500
SHARE_HOSTS = ("drive.google.com", "docs.google.com")
CREDENTIAL_KEYS = ("token", "access_token", "password", "key", "secret")
CONNECTABLE_TYPES = ("local_repo", "remote_file_link", "google_drive_selection")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)\z", 1))


def media_type(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(content_type), ";", 1))


def classify(name: Column, content_type: Column) -> Column:
    """struct<file_format,method,difficulty> of a file; the first matching format wins."""

    def choose(k: Column) -> Column:
        suffix, kind = k["suffix"], k["kind"]
        out = None
        for fmt, method, difficulty, suffixes, kinds, ending in FORMATS:
            test = suffix.isin(*suffixes)
            if kinds:
                test = test | kind.isin(*kinds)
            if ending:
                test = test | (kind.startswith("video/") if ending == "video/*" else kind.endswith(ending))
            value = F.struct(F.lit(fmt).alias("file_format"), F.lit(method).alias("method"), F.lit(difficulty).alias("difficulty"))
            out = F.when(test, value) if out is None else out.when(test, value)

        def plain(fmt: Column, method: str, difficulty: str) -> Column:
            return F.struct(fmt.alias("file_format"), F.lit(method).alias("method"), F.lit(difficulty).alias("difficulty"))

        named = F.coalesce(F.nullif(F.ltrim(suffix, F.lit(".")), F.lit("")), F.lit("text"))
        out = out.when(suffix.isin(*PLAIN_SUFFIXES) | kind.startswith("text/"), plain(named, "utf8_text", "easy"))
        out = out.when((suffix == "") & kind.isin(*SNIFFED_TYPES), plain(F.lit("text"), "sniffed_unicode_text", "easy"))
        return out.otherwise(plain(F.lit("unsupported"), "unsupported", "unsupported"))

    return let(F.struct(suffix_of(name).alias("suffix"), media_type(content_type).alias("kind")), choose)


def size_gate(files: DataFrame) -> DataFrame:
    """Byte limit by kind of file, and what happens to files above it. Decided before any content is read."""
    suffix = suffix_of(F.col("name"))
    limit = (
        F.when(suffix.isin(*VIDEO_SUFFIXES), VIDEO_BYTES).when(suffix.isin(*COMPLEX_SUFFIXES), COMPLEX_BYTES).otherwise(TEXT_BYTES)
    )
    gated = files.withColumn("max_bytes", limit)
    too_big = F.col("size_bytes") > F.col("max_bytes")
    return gated.withColumn(
        "rejected", F.when(too_big & suffix.isin(*VIDEO_SUFFIXES), "ocr_deferred").when(too_big, "unsupported"))


def file_cap(files: DataFrame, cap: int = SOURCE_FILES, salts: int = 64) -> DataFrame:
    """The first files of every source by path: an optional sample of a source.

    A source may hold a large part of all files, so each salt of it is cut to `cap` first and only
    those few rows are ranked together.
    """
    salt = F.pmod(F.xxhash64("path"), F.lit(salts))
    first = Window.partitionBy("source_id", "salt").orderBy("path")
    last = Window.partitionBy("source_id").orderBy("path")
    some = files.withColumn("salt", salt).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= cap)
    return some.drop("n", "salt").withColumn("n", F.row_number().over(last)).filter(F.col("n") <= cap)


def with_over_cap(files: DataFrame, cap: int = SOURCE_FILES) -> DataFrame:
    """All files; those after the first `cap` of their source by path are `over_cap`. Only the last path within the cap is
    worked out for each source, so no source is ranked as a whole."""
    last = file_cap(files.select("source_id", "path"), cap).groupBy("source_id").agg(F.max("path").alias("_last"), F.count("*").alias("_n"))
    joined = files.join(last, "source_id", "left")
    return joined.withColumn("over_cap", (F.col("_n") >= cap) & (F.col("path") > F.col("_last"))).drop("_last", "_n")


def decode_text(content: Column, content_type: Column) -> Column:
    """Text of raw bytes: declared charset, byte order mark, UTF-8, UTF-16 by its zero bytes.

    Bytes no charset fits are read as UTF-8 with replacement marks.
    """
    charset = F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))
    head = F.hex(F.substring(content, 1, 200))
    pairs = F.regexp_extract_all(head, F.lit("[0-9A-F]{4}"), F.lit(0))
    even = F.size(F.filter(pairs, lambda p: p.startswith("00")))
    odd = F.size(F.filter(pairs, lambda p: p.endswith("00")))
    many = F.greatest(F.lit(2), F.floor(F.length(head) / 12))
    utf8 = F.is_valid_utf8(content.cast("string"))

    def without_mark(text: Column) -> Column:
        return F.ltrim(text, F.lit("﻿"))

    def wide(kind: str) -> Column:
        return without_mark(F.decode(content, kind))

    little = charset.isin("utf16le", "utf-16le", "utf_16_le", "utf-16-le")
    big = charset.isin("utf16be", "utf-16be", "utf_16_be", "utf-16-be")
    return (
        F.when(little, wide("UTF-16LE"))
        .when(big, wide("UTF-16BE"))
        .when(charset.isin("iso-8859-1", "latin-1", "latin1"), F.decode(content, "ISO-8859-1"))
        .when(head.startswith("FFFE"), wide("UTF-16LE"))
        .when(head.startswith("FEFF"), wide("UTF-16BE"))
        .when(utf8 & (even < many) & (odd < many), without_mark(content.cast("string")))
        .when((odd >= many) & (odd >= even), wide("UTF-16LE"))
        .when(even >= many, wide("UTF-16BE"))
        .otherwise(without_mark(F.make_valid_utf8(content.cast("string"))))
    )


# Charsets that decode_text reads itself.
OWN_CHARSETS = (
    "", "utf8", "utf-8", "utf_8", "utf16le", "utf-16le", "utf_16_le", "utf-16-le", "utf16be", "utf-16be", "utf_16_be", "utf-16-be",
    "iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii",
)


def declared_charset(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", 1))


def with_decoded_text(files: DataFrame, content: str = "content", content_type: str = "content_type", text: str = "text") -> DataFrame:
    """Add the text of raw bytes, in whatever charset the content type declares.

    Charsets that Spark does not know are decoded in Arrow batches; the bytes of all other files stay in the JVM. Bytes that
    the declared charset does not fit, and unknown charsets, are read as by `decode_text`.
    """

    def decode(contents: pa.Array, charsets: pa.Array) -> pa.Array:
        out = []
        for raw, charset in zip(contents.to_pylist(), charsets.to_pylist()):
            try:
                out.append(None if raw is None else raw.decode(charset))
            except (LookupError, UnicodeError):
                out.append(None)
        return pa.array(out, pa.string())

    charset = declared_charset(F.coalesce(F.col(content_type), F.lit("")))
    other = ~charset.isin(*OWN_CHARSETS)
    foreign = F.arrow_udf(decode, StringType())(F.when(other, F.col(content)), F.when(other, charset))
    own = decode_text(F.col(content), F.coalesce(F.col(content_type), F.lit("")))
    return files.withColumn("_foreign", foreign).withColumn(text, F.coalesce("_foreign", own)).drop("_foreign")


def looks_like_text(text: Column) -> Column:
    """A file without a suffix counts as text: few replacement marks, few control characters, a letter or digit."""
    chars = F.greatest(F.length(text), F.lit(1))
    replaced = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    controls = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0e-\x1f]", ""))
    return (
        text.rlike(f"[^{SPACE}]") & (replaced / chars <= 0.01) & (controls / chars <= 0.01) & text.rlike(r"[\p{L}\p{N}]")
    )


def scan_ready(sources: DataFrame, adapters: DataFrame) -> DataFrame:
    """Sources whose adapter exists and whose status fits it. Adapters are a handful of rows per type."""
    known = adapters.select("source_type", F.col("status").alias("adapter_status"))
    kind, status = F.col("source_type"), F.col("status")
    connected = (status == "connected") | ((kind == "google_drive_selection") & (status == "authorization_required"))
    ready = ((status == "mock_ready") & (F.col("adapter_status") == "mock_ready")) | (
        kind.isin(*CONNECTABLE_TYPES) & connected & (F.col("adapter_status") == "connected"))
    return sources.join(known, "source_type", "left").withColumn("ready", F.coalesce(ready, F.lit(False)))


def reference_denied(url: Column) -> Column:
    """Why a remote reference may not be scanned; null if it may."""
    def part(name: str) -> Column:
        return F.try_parse_url(url, F.lit(name))

    host = F.lower(part("HOST"))
    keys = F.transform(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: F.substring_index(p, "=", 1))
    return (
        F.when(F.coalesce(F.lower(part("PROTOCOL")), F.lit("")) != "https", "not_https")
        .when(part("USERINFO").isNotNull(), "credentials")
        .when(F.coalesce(host, F.lit("")) == "", "no_host")
        .when(host.isin(*SHARE_HOSTS), "share_link")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, CREDENTIAL_KEYS))), "credentials")
    )
