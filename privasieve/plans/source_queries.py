"""Queries for sources, sinks and text extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..operators import extract, inventory, summaries
from ..sources import files as file_source
from ..sources.tables import corpus, source_documents, spread, table
from .finding_queries import FINDINGS, SCAN, _files, _findings
from .oracle_base import CORPUS, LINES, quote, values
from .registry import query

_PATH_SQL = "concat(source, '/', lang, '/doc_', doc_id, '.txt')"


def _docs(spark, directory):
    return source_documents(table(spark, directory, "documents"))


@query("src_documents_scan", "doc_id bigint, path varchar, size_bytes bigint, family varchar",
       f"SELECT doc_id, {_PATH_SQL} AS path, strlen(text) AS size_bytes, lang AS family FROM documents")
def documents_scan(spark, directory):
    return _docs(spark, directory)


@query("src_inventory_summary", "source_id varchar, family varchar, candidate_files bigint, bytes bigint, flagged_files bigint",
       "SELECT source_id, family, count(*) AS candidate_files, sum(size_bytes) AS bytes, count(f) AS flagged_files FROM (SELECT files.*, fnd.doc_id AS f FROM files LEFT JOIN fnd USING (doc_id)) x GROUP BY 1, 2", FINDINGS)
def inventory_summary(spark, directory):
    return summaries.inventory_summary(_files(spark, directory).drop("text"), _findings(spark, directory))


_SUFFIXES = sorted({s for f in inventory.FORMATS for s in f[3]} | {".txt", ".log", ".exe", ""})
_TYPES = ("", "text/plain; charset=utf-8", "Application/JSON", "application/octet-stream", "video/mp4", "image/png", "text/csv")
_NAME_SQL = "CASE doc_id % {n} ".format(n=len(_SUFFIXES)) + " ".join(f"WHEN {i} THEN concat('File_', doc_id, {quote(s.upper() if i % 2 else s)})" for i, s in enumerate(_SUFFIXES)) + " END"
_TYPE_SQL = "CASE (doc_id - doc_id % {n}) % 7 ".format(n=len(_SUFFIXES)) + " ".join(f"WHEN {i} THEN {quote(t)}" for i, t in enumerate(_TYPES)) + " END"
_LISTING = f"SELECT doc_id, {_NAME_SQL} AS name, {_TYPE_SQL} AS content_type, n_chars * 3000 AS size_bytes FROM documents"


def _listing(spark, directory):
    docs = table(spark, directory, "documents")
    return docs.select("doc_id", F.expr(_NAME_SQL).alias("name"), F.expr(_TYPE_SQL).alias("content_type"), (F.col("n_chars") * 3000).alias("size_bytes"))


def _format_case(column: int) -> str:
    out = "CASE "
    for f in inventory.FORMATS:
        test = f"suffix IN {values(f[3])}"
        if f[4]:
            test += f" OR kind IN {values(f[4])}"
        if f[5]:
            test += f" OR starts_with(kind, 'video/')" if f[5] == "video/*" else f" OR ends_with(kind, {quote(f[5])})"
        out += f"WHEN {test} THEN {quote(f[column])} "
    plain = ("CASE WHEN suffix = '' THEN 'text' ELSE substring(suffix, 2) END", "'utf8_text'", "'easy'")[column]
    sniff = ("'text'", "'sniffed_unicode_text'", "'easy'")[column]
    return out + f"WHEN suffix IN ('.txt', '.log') OR starts_with(kind, 'text/') THEN {plain} WHEN suffix = '' AND kind IN {values(inventory.SNIFFED_TYPES)} THEN {sniff} ELSE 'unsupported' END"


@query("src_format_classify", "doc_id bigint, file_format varchar, method varchar, difficulty varchar",
       f"SELECT doc_id, {_format_case(0)} AS file_format, {_format_case(1)} AS method, {_format_case(2)} AS difficulty FROM "
       f"(SELECT doc_id, lower(regexp_extract(name, '\\.[^.]+$')) AS suffix, trim(string_split(lower(content_type), ';')[1]) AS kind FROM ({_LISTING}) l) k")
def format_classify(spark, directory):
    return _listing(spark, directory).select("doc_id", inventory.classify(F.col("name"), F.col("content_type")).alias("f")).select("doc_id", "f.*")


@query("src_size_gate", "doc_id bigint, max_bytes bigint, rejected varchar",
       f"SELECT doc_id, m AS max_bytes, CASE WHEN size_bytes > m THEN CASE WHEN suffix IN {values(inventory.VIDEO_SUFFIXES)} THEN 'ocr_deferred' ELSE 'unsupported' END END AS rejected FROM "
       f"(SELECT *, CASE WHEN suffix IN {values(inventory.COMPLEX_SUFFIXES + inventory.VIDEO_SUFFIXES)} THEN 8000000 ELSE 1000000 END AS m FROM (SELECT *, lower(regexp_extract(name, '\\.[^.]+$')) AS suffix FROM ({_LISTING}) l) k) g")
def size_gate(spark, directory):
    return inventory.size_gate(_listing(spark, directory))


@query("src_file_cap", "source_id varchar, path varchar, n int",
       f"SELECT source AS source_id, {_PATH_SQL} AS path, row_number() OVER (PARTITION BY source ORDER BY {_PATH_SQL}) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_PATH_SQL}) <= 20")
def file_cap(spark, directory):
    return inventory.file_cap(_docs(spark, directory).select("source_id", "path"), cap=20)


@query("src_file_cap_flags", "source_id varchar, path varchar, over_cap boolean",
       f"SELECT source AS source_id, {_PATH_SQL} AS path, row_number() OVER (PARTITION BY source ORDER BY {_PATH_SQL}) > 20 AS over_cap FROM documents")
def file_cap_flags(spark, directory):
    return inventory.with_over_cap(_docs(spark, directory).select("source_id", "path"), cap=20)


@query("src_decode_text", "doc_id bigint, text_hash varchar", "SELECT doc_id, substring(sha256(text), 1, 16) AS text_hash FROM documents")
def decode_text(spark, directory):
    text, kind = F.col("text"), F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-16BE"))
    )
    declared = F.when(kind == 3, "text/plain; charset=utf-16be").otherwise("text/plain")
    docs = table(spark, directory, "documents").select("doc_id", content.alias("content"), declared.alias("content_type"))
    return docs.select("doc_id", short_hash(inventory.decode_text(F.col("content"), F.col("content_type")), 16).alias("text_hash"))


@query("src_decode_charsets", "doc_id bigint, text_hash varchar", "SELECT doc_id, substring(sha256(text), 1, 16) AS text_hash FROM documents")
def decode_charsets(spark, directory):
    """Each text as bytes of a charset that holds it, declared as such: an old Western code page, UTF-32 under a name that only
    the batch decoder knows, or UTF-8 under a name that nobody knows."""
    docs = table(spark, directory, "documents")
    text = F.col("text")
    western = text.rlike(r"\A[\x00-\x7F\xA0-\xFF]*\z") & (F.col("doc_id") % 3 == 0)
    content = F.when(western, F.encode(F.when(western, text), "ISO-8859-1")).when(F.col("doc_id") % 3 == 1, F.encode(text, "UTF-32")).otherwise(F.encode(text, "UTF-8"))
    declared = F.when(western, "text/plain; charset=Windows-1252").when(F.col("doc_id") % 3 == 1, 'text/plain; charset="utf-32-be"').otherwise("text/plain; charset=x-nobody")
    files = docs.select("doc_id", content.alias("content"), declared.alias("content_type"))
    return inventory.with_decoded_text(files).select("doc_id", short_hash(F.col("text"), 16).alias("text_hash"))


_SNIFF_TEXT = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(repeat(chr(1), CAST(1 + n_chars / 40 AS INT)), text) WHEN 2 THEN concat(repeat(chr(65533), CAST(1 + n_chars / 40 AS INT)), text) ELSE ' ... ' END"


@query("src_text_sniff", "doc_id bigint, is_text boolean", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN regexp_matches(text, '[\\p{L}\\p{N}]') ELSE false END AS is_text FROM documents")
def text_sniff(spark, directory):
    # chr() of the engine stops at 255, so the replacement mark is written out.
    shown = _SNIFF_TEXT.replace("chr(65533)", "'�'")
    return table(spark, directory, "documents").select("doc_id", inventory.looks_like_text(F.expr(shown)).alias("is_text"))


_TYPE_OF = "CASE s_suppkey % 4 WHEN 0 THEN 'local_repo' WHEN 1 THEN 'google_drive_selection' WHEN 2 THEN 'organizer_sample_repo' ELSE 'sharepoint' END"
_STATE_OF = "CASE s_nationkey % 4 WHEN 0 THEN 'connected' WHEN 1 THEN 'authorization_required' WHEN 2 THEN 'mock_ready' ELSE 'disabled' END"
_ADAPTERS = (("organizer_sample_repo", "mock_ready"), ("local_repo", "connected"), ("remote_file_link", "connected"), ("google_drive_selection", "connected"))


@query("src_scan_ready", "s_suppkey bigint, ready boolean",
       f"SELECT s_suppkey, (t = 'organizer_sample_repo' AND st = 'mock_ready') OR (t = 'local_repo' AND st = 'connected') OR (t = 'google_drive_selection' AND st IN ('connected', 'authorization_required')) AS ready FROM (SELECT s_suppkey, {_TYPE_OF} AS t, {_STATE_OF} AS st FROM supplier) s")
def scan_ready(spark, directory):
    sources = table(spark, directory, "supplier").select("s_suppkey", F.expr(_TYPE_OF).alias("source_type"), F.expr(_STATE_OF).alias("status"))
    return inventory.scan_ready(sources, F.broadcast(spark.createDataFrame(list(_ADAPTERS), "source_type string, status string")))


_URL = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http:', 'https:') WHEN 2 THEN concat('https://me:pw@example.org/', page_id) WHEN 3 THEN concat('https://drive.google.com/file/', page_id) WHEN 4 THEN concat('https://example.org/x?a=1&token=', page_id) ELSE concat('file:///', page_id) END"


@query("src_reference_policy", "page_id bigint, denied_reason varchar",
       "SELECT page_id, CASE WHEN NOT starts_with(u, 'https://') THEN 'not_https' WHEN regexp_matches(u, '^https://[^/]*@') THEN 'credentials' WHEN regexp_matches(u, '^https://(drive|docs)\\.google\\.com') THEN 'share_link' "
       f"WHEN regexp_matches(u, '[?&](token|access_token|password|key|secret)=') THEN 'credentials' END AS denied_reason FROM (SELECT page_id, {_URL} AS u FROM pages) p")
def reference_policy(spark, directory):
    return table(spark, directory, "pages").select("page_id", inventory.reference_denied(F.expr(_URL)).alias("denied_reason"))


@query("snk_result_tables", "finding_id varchar, source_id varchar, risk_level varchar",
       "SELECT finding_id, source_id, risk_level FROM fnd WHERE source_id NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0)", FINDINGS)
def result_tables(spark, directory):
    path = f"{file_source.shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    rows = _findings(spark, directory).select("finding_id", "source_id", F.lit(SCAN).alias("scan_id"), "risk_level", "file_key")
    file_source.write_results(rows, path)
    deleted = table(spark, directory, "nation").filter("n_regionkey = 0").select(F.col("n_name").alias("source_id"))
    return file_source.purge(spark.read.parquet(path), deleted)


# --- extraction --------------------------------------------------------------------------------


@query("ext_fragment_offsets", "doc_id bigint, ordinal int, fragment_start int", "SELECT doc_id, line_number AS ordinal, line_start AS fragment_start FROM ln", f"{CORPUS}, {LINES}")
def fragment_offsets(spark, directory):
    parts = corpus(spark, directory).select("doc_id", extract.fragment_offsets(F.split("text", "\n", -1)).alias("o"))
    return parts.select("doc_id", F.posexplode("o").alias("i", "fragment_start")).withColumn("ordinal", F.col("i") + 1)


@query("ext_join_text", "doc_id bigint, chars int, text_hash varchar",
       "SELECT doc_id, length(t) AS chars, substring(sha256(t), 1, 16) AS text_hash FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_number) AS t FROM ln WHERE line <> '' GROUP BY doc_id) x", f"{CORPUS}, {LINES}")
def join_text(spark, directory):
    fragments = F.filter(F.split("text", "\n", -1), lambda f: f != "")
    joined = corpus(spark, directory).select("doc_id", extract.join_fragments(fragments).alias("t")).filter("t <> ''")
    return joined.select("doc_id", F.length("t").alias("chars"), short_hash(F.col("t"), 16).alias("text_hash"))


@query("ext_plain_text", "doc_id bigint, end_pos int, line_count int, last_start int",
       "SELECT doc_id, length(text) AS end_pos, count(*) AS line_count, max(line_start) AS last_start FROM ln JOIN corpus USING (doc_id) WHERE line_start = 0 OR line_start < length(text) GROUP BY doc_id, text", f"{CORPUS}, {LINES}")
def plain_text(spark, directory):
    found = corpus(spark, directory).select("doc_id", extract.plain_text(F.col("text")).alias("p"))
    return found.select("doc_id", F.col("p.end").alias("end_pos"), F.size("p.line_starts").alias("line_count"), F.element_at("p.line_starts", -1).alias("last_start"))


_FRAGMENT_COLUMNS = "doc_id bigint, ordinal int, fragment varchar, value_start int, value_end int, path varchar, label varchar"


def _rendered(spark, directory, expression):
    customers = spread(table(spark, directory, "customer"))
    return customers.withColumn("k", F.col("c_custkey")).select(F.col("k").alias("doc_id"), F.expr(expression).alias("text"))


def _expected(shapes: dict[int, list[tuple[str, str, str, str]]], modulus: int) -> str:
    """Expected fragments per customer, (label, value, path, place) by shape, placed by running sums."""
    rows = " UNION ALL ".join(
        f"SELECT c_custkey AS doc_id, {n} AS ordinal, {label} AS l, {value} AS v, {path} AS path, {where} AS label FROM (SELECT *, c_custkey AS k FROM customer) c WHERE c_custkey % {modulus} = {shape}"
        for shape, items in shapes.items() for n, (label, value, path, where) in enumerate(items, start=1)
    )
    return (
        "SELECT doc_id, ordinal, fragment, before + length(fragment) - length(v) AS value_start, before + length(fragment) AS value_end, path, label FROM (SELECT *, "
        "coalesce(sum(length(fragment) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM "
        f"(SELECT doc_id, ordinal, CASE WHEN l = '' THEN v ELSE l || ': ' || v END AS fragment, v, path, label FROM ({rows}) r) f) g"
    )


def _cell(label, value, row, column):
    return (quote(label) if not label.startswith("=") else label[1:], value, quote(f"{row},{column}"), quote(f"row {row} column {'ABC'[column - 1]}"))


_CSV = (
    "CASE k % 4 WHEN 0 THEN concat('Name,Email,Note', chr(10), c_name, ',u', k, '@example.org,\"a, \"\"b\"\" ', k, '\"', chr(10), chr(10), 'Second ', k, ',,x') "
    "WHEN 1 THEN concat('Field;Value', chr(10), 'Name;', c_name, chr(10), 'Phone;+49 30 ', k, '00') WHEN 2 THEN concat('just one cell', chr(10), c_name, '|', c_mktsegment) "
    "ELSE concat('Id|Text', chr(10), k, '|\"two', chr(10), 'lines\"', chr(10), '|only second') END"
)
_CSV_EXPECTED = _expected({
    0: [_cell("Name", "c_name", 2, 1), _cell("Email", "concat('u', k, '@example.org')", 2, 2), _cell("Note", "concat('a, \"b\" ', k)", 2, 3), _cell("Name", "concat('Second ', k)", 4, 1), _cell("Note", "'x'", 4, 3)],
    1: [_cell("Name", "c_name", 2, 2), _cell("Phone", "concat('+49 30 ', k, '00')", 3, 2)],
    2: [_cell("", "'just one cell'", 1, 1), _cell("", "concat(c_name, '|', c_mktsegment)", 2, 1)],
    3: [_cell("Id", "concat(k, '')", 2, 1), _cell("Text", "concat('two', chr(10), 'lines')", 2, 2), _cell("Text", "'only second'", 3, 2)],
}, 4)


@query("ext_delimited", _FRAGMENT_COLUMNS, _CSV_EXPECTED)
def delimited(spark, directory):
    return extract.extracted(_rendered(spark, directory, _CSV), extract.delimited(F.col("text")))


_JSON = (
    "CASE k % 2 WHEN 0 THEN concat('{\"name\": \"', c_name, '\", \"contact\": {\"mail\": \"u', k, '@example.org\", \"tags\": [\"a\", ', k, ', null, true]}, \"note\": \"\"}') "
    "ELSE concat('[{\"z\": ', k, ', \"a\": {\"b\": {\"c\": \"deep\"}}}, \"end\"]') END"
)
_JSON_EXPECTED = _expected({
    0: [("'name'", "c_name", "'/field[1]'", "'JSON field 1'"), ("'mail'", "concat('u', k, '@example.org')", "'/field[2]/field[1]'", "'JSON field 2.1'"),
        ("'tags'", "'a'", "'/field[2]/field[2]/item[1]'", "'JSON field 2.2'"), ("'tags'", "concat(k, '')", "'/field[2]/field[2]/item[2]'", "'JSON field 2.2'"),
        ("'tags'", "'true'", "'/field[2]/field[2]/item[4]'", "'JSON field 2.2'")],
    1: [("'z'", "concat(k, '')", "'/item[1]/field[1]'", "'JSON field 1'"), ("'c'", "'deep'", "'/item[1]/field[2]/field[1]/field[1]'", "'JSON field 2.1.1'"), ("''", "'end'", "'/item[2]'", "'JSON field value'")],
}, 2)


@query("ext_json_flatten", _FRAGMENT_COLUMNS, _JSON_EXPECTED)
def json_flatten(spark, directory):
    return extract.extracted(_rendered(spark, directory, _JSON), extract.json_scalars(F.col("text")))


_XML = "concat('<?xml version=\"1.0\"?><doc xmlns:p=\"x\" id=\"', k, '\"><!-- no --><p:name first=\"A &amp; B\">', c_name, '</p:name><empty/><list><item> one  two </item><item>', c_mktsegment, '</item></list></doc>')"
_XML_EXPECTED = _expected({0: [
    ("'id'", "concat(k, '')", "'/element[1]/attribute[1]'", "'XML element 1 attribute 1'"),
    ("'first'", "'A & B'", "'/element[1]/element[1]/attribute[1]'", "'XML element 1.1 attribute 1'"), ("'name'", "c_name", "'/element[1]/element[1]'", "'XML element 1.1'"),
    ("'item'", "'one two'", "'/element[1]/element[3]/element[1]'", "'XML element 1.3.1'"), ("'item'", "c_mktsegment", "'/element[1]/element[3]/element[2]'", "'XML element 1.3.2'")]}, 1)


@query("ext_xml_scalars", _FRAGMENT_COLUMNS, _XML_EXPECTED)
def xml_scalars(spark, directory):
    return extract.extracted(_rendered(spark, directory, _XML), extract.xml_scalars(F.col("text")))


_TRIM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_HTML_SQL = (
    "SELECT doc_id, count(*) AS nodes, sum(length(v)) AS chars FROM (SELECT page_id AS doc_id, "
    + _TRIM.format("replace(replace(replace(replace(replace(replace(replace(u, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")
    + " AS v FROM (SELECT page_id, unnest(string_split_regex(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)', '<t></t', 'g'), '<[^>]*>')) AS u FROM bare) t "
    "UNION ALL SELECT page_id, " + _TRIM.format("s") + " FROM (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<(?:script|style)[^>]*>(.*?)</(?:script|style)', 1)) AS s FROM bare) x) n WHERE v <> '' GROUP BY doc_id"
)


@query("ext_html_text", "doc_id bigint, nodes bigint, chars bigint", _HTML_SQL,
       "bare AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages)")
def html_text(spark, directory):
    pages = spread(table(spark, directory, "pages")).select(F.col("page_id").alias("doc_id"), extract.html_texts(F.col("html")).alias("f"))
    return pages.select("doc_id", F.size("f").alias("nodes"), F.aggregate("f", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("chars")).filter("nodes > 0")


_MD = "concat('# Title ', k, chr(10), chr(10), '| Name | Mail |', chr(10), '| --- | :---: |', chr(10), '| ', c_name, ' | u', k, '@example.org |', chr(10), '| only \\\\| one | |', chr(10), '  after ', k, chr(10), 'a | b')"
_MD_EXPECTED = _expected({0: [
    ("''", "concat('# Title ', k)", "'1'", "'Line 1'"), _cell("Name", "c_name", 5, 1), _cell("Mail", "concat('u', k, '@example.org')", 5, 2), _cell("Name", "'only | one'", 6, 1),
    ("''", "concat('after ', k)", "'7'", "'Line 7'"), ("''", "'a | b'", "'8'", "'Line 8'")]}, 1)


@query("ext_markdown", _FRAGMENT_COLUMNS, _MD_EXPECTED)
def markdown(spark, directory):
    return extract.extracted(extract.with_markdown(_rendered(spark, directory, _MD)), F.col("fragments"))


_CUES = "concat('WEBVTT', chr(10), chr(10), turn + 1, chr(10), '00:00:0', turn % 10, '.000 --> 00:00:09.000', chr(10), '  ', text)"


@query("ext_transcript", "conv_id bigint, turn bigint, text_hash varchar",
       "SELECT conv_id, turn, substring(sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '-->') AND upper(x) <> 'WEBVTT'), chr(10))), 1, 16) AS text_hash FROM conversations")
def transcript(spark, directory):
    cues = table(spark, directory, "conversations").select("conv_id", "turn", F.expr(_CUES).alias("body"))
    return cues.select("conv_id", "turn", short_hash(extract.clean_transcript(F.col("body")), 16).alias("text_hash"))


_BROKEN = "CASE doc_id % 8 WHEN 3 THEN '   ' WHEN 5 THEN NULL ELSE text END"


@query("ext_failures", "doc_id bigint, issue varchar, difficulty varchar",
       "SELECT doc_id, CASE doc_id % 8 WHEN 3 THEN 'no_text' ELSE 'malformed' END AS issue, CASE doc_id % 8 WHEN 3 THEN 'hard' ELSE 'unsupported' END AS difficulty FROM documents WHERE doc_id % 8 IN (3, 5)")
def failures(spark, directory):
    docs = table(spark, directory, "documents")
    return extract.split_outcomes(extract.with_outcome(docs, F.expr(_BROKEN)))[1]
