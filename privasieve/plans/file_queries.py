"""Queries over files: one plan from bytes or text of any format to located signals, public evidence and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..operators import anchors, extract
from ..sources.tables import spread, table
from . import file_scan
from .registry import query

# One file for each customer, in ten shapes; the mail address stands at a known place of each.
_MAIL = "concat('u', k, '@example.org')"
_SHAPES = (
    ("csv", "", f"concat('Name,Mail', chr(10), 'x,', {_MAIL})"),
    ("json", "", f"concat('{{\"id\": ', k, ', \"c\": {{\"list\": \"[1]\", \"mail\": \"', {_MAIL}, '\"}}}}')"),
    ("xml", "", f"concat('<d><p>x</p><p m=\"', {_MAIL}, '\"/></d>')"),
    ("html", "", f"concat('<html><body><p>hi</p><p>mail <b>', {_MAIL}, '</b></p></body></html>')"),
    ("md", "", f"concat('# Title', chr(10), chr(10), '   ask ', {_MAIL})"),
    ("txt", "", f"concat('first line', chr(10), 'ask ', {_MAIL})"),
    ("json", "", f"concat('{{\"mail\": \"', {_MAIL}, '\"')"),
    ("ndjson", "", f"concat('{{\"a\": 1}}', chr(10), '{{\"m\": \"', {_MAIL}, '\"}}')"),
    ("bin", "text/tab-separated-values", f"concat('Field', chr(9), 'Value', chr(10), 'Mail', chr(9), {_MAIL})"),
    ("pdf", "application/pdf", f"concat('%PDF ', {_MAIL})"),
)
_TEXT = f"CASE k % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {body}" for i, (_, _, body) in enumerate(_SHAPES)) + " END"
_NAME = f"CASE k % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN concat('file_', k, '.{suffix}')" for i, (suffix, _, _) in enumerate(_SHAPES)) + " END"
_TYPE = f"CASE k % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind, _) in enumerate(_SHAPES)) + " END"

# format, selector, path, label, line, column, where the address begins in its place, and in the joined text
_PLACES = {
    0: ("csv", "tableCell", "2,2", "row 2 column B", None, None, 0, "length('Name: x') + 1 + length('Mail: ')"),
    1: ("json", "structurePath", "/field[2]/field[2]", "JSON field 2.2", None, None, 0, "length(concat('id: ', k)) + 1 + length('list: [1]') + 1 + length('mail: ')"),
    2: ("xml", "structurePath", "/element[1]/element[2]/attribute[1]", "XML element 1.2 attribute 1", None, None, 0, "length('p: x') + 1 + length('m: ')"),
    3: ("html", "structurePath", "/html[1]/body[1]/p[2]/b[1]", "HTML b 1", None, None, 0, "length('hi') + 1 + length('mail') + 1"),
    4: ("markdown", "textPosition", None, "Line 3", 3, 8, 4, "length('# Title') + 1 + length('ask ')"),
    5: ("txt", "textPosition", None, "Text content", 2, 5, 15, "length('first line') + 1 + length('ask ')"),
    7: ("ndjson", "structurePath", "/record[2]/field[1]", "NDJSON record 2 field 1", None, None, 0, "length('a: 1') + 1 + length('m: ')"),
    8: ("tsv", "tableCell", "2,2", "row 2 column B", None, None, 0, "length('Mail: ')"),
}


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"


_EXPECTED = " UNION ALL ".join(
    f"SELECT k AS doc_id, {_value(fmt)} AS file_format, {_value(kind)} AS selector, {_value(path)} AS path, {_value(label)} AS label, {_value(line)} AS line, {_value(column)} AS column_number, "
    f"{start} AS source_start, {start} + length({_MAIL}) AS source_end, {at} AS start_pos FROM files WHERE k % {len(_SHAPES)} = {shape}"
    for shape, (fmt, kind, path, label, line, column, start, at) in _PLACES.items()
)
_FILES = "files AS (SELECT c_custkey AS k FROM customer)"


def _scanned(spark, directory):
    customers = spread(table(spark, directory, "customer")).select(F.col("c_custkey").alias("k"))
    files = customers.select(F.col("k").alias("doc_id"), F.expr(_NAME).alias("name"), F.expr(_TYPE).alias("content_type"), F.expr(_TEXT).alias("text"))
    return file_scan.scan_files(files)


@query(
    "anc_file_signals", "doc_id bigint, file_format varchar, selector varchar, path varchar, label varchar, line int, column_number int, source_start int, source_end int, start_pos int",
    _EXPECTED, _FILES,
)
def file_signals(spark, directory):
    rows = file_scan.signal_rows(_scanned(spark, directory)).filter("detector = 'email_pattern'")
    return rows.withColumnsRenamed({"column": "column_number", "start": "start_pos"})


@query(
    "ext_file_failures", "doc_id bigint, file_format varchar, issue varchar, difficulty varchar",
    f"SELECT k AS doc_id, CASE k % {len(_SHAPES)} WHEN 6 THEN 'json' ELSE 'pdf' END AS file_format, CASE k % {len(_SHAPES)} WHEN 6 THEN 'malformed' ELSE 'unsupported' END AS issue, "
    f"CASE k % {len(_SHAPES)} WHEN 6 THEN 'unsupported' ELSE 'moderate' END AS difficulty FROM files WHERE k % {len(_SHAPES)} IN (6, 9)", _FILES,
)
def file_failures(spark, directory):
    return file_scan.failure_rows(_scanned(spark, directory))


@query(
    "anc_file_evidence", "doc_id bigint, type varchar, location_label varchar, beyond_top boolean",
    f"SELECT doc_id, 'email' AS type, CASE WHEN label IN ('Text content') THEN 'Detected text' ELSE label END AS location_label, false AS beyond_top FROM ({_EXPECTED}) e", _FILES,
)
def file_evidence(spark, directory):
    evidence = anchors.public_evidence(file_scan.signal_rows(_scanned(spark, directory)))
    return evidence.filter("detector = 'email_pattern'")


@query(
    "ext_event_props", "event_id bigint, path varchar, fragment varchar, label varchar",
    "SELECT event_id, '/field[' || n || ']' AS path, concat(key, ': ', value) AS fragment, 'JSON field ' || n AS label FROM ("
    "SELECT event_id, unnest(json_keys(props)) AS key, unnest(list_transform(json_keys(props), lambda x: json_extract_string(props, concat('$.\"', x, '\"')))) AS value, "
    "unnest(range(1, len(json_keys(props)) + 1)) AS n FROM events) e WHERE value IS NOT NULL AND value <> ''",
)
def event_props(spark, directory):
    events = table(spark, directory, "events").select("event_id", "props")
    return extract.extracted(events, extract.json_scalars(F.col("props")), "event_id")


# The tokens of a page, walked one by one with the stack of open tags. Bodies of scripts and styles are put aside first.
_NODES = (
    "RECURSIVE bare AS (SELECT page_id, regexp_replace(html, '(?is)(<(?:script|style)[^>]*>).*?(</(?:script|style))', '\\1' || chr(1) || '\\2', 'g') AS h, "
    "regexp_extract_all(html, '(?is)<(?:script|style)[^>]*>(.*?)</(?:script|style)', 1) AS bodies FROM pages), "
    "tok AS (SELECT page_id, generate_subscripts(t, 1) AS i, unnest(t) AS x, bodies FROM (SELECT page_id, bodies, regexp_extract_all(h, '(?s)<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<') AS t FROM bare) b), "
    "kind AS (SELECT page_id, i, x, bodies, lower(regexp_extract(x, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag, starts_with(x, '</') AS closing, "
    "CAST(sum(CASE WHEN x = chr(1) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS body FROM tok), "
    "walk AS (SELECT page_id, 0::BIGINT AS i, []::VARCHAR[] AS names, []::BIGINT[] AS ups FROM bare UNION ALL "
    "SELECT w.page_id, k.i, CASE WHEN k.tag = '' THEN names WHEN closing THEN names[1:coalesce(list_max([j FOR j IN range(1, len(names) + 1) IF names[j] = k.tag]), 1) - 1] "
    "WHEN ends_with(x, '/>') THEN names ELSE list_append(names, k.tag) END, "
    "CASE WHEN k.tag = '' THEN ups WHEN closing THEN ups[1:coalesce(list_max([j FOR j IN range(1, len(names) + 1) IF names[j] = k.tag]), 1) - 1] WHEN ends_with(x, '/>') THEN ups ELSE list_append(ups, k.i) END "
    "FROM walk w JOIN kind k ON k.page_id = w.page_id AND k.i = w.i + 1), "
    "num AS (SELECT k.page_id, k.i, k.tag, row_number() OVER (PARTITION BY k.page_id, array_to_string(p.names, '/'), k.tag ORDER BY k.i) AS n "
    "FROM kind k JOIN walk p ON p.page_id = k.page_id AND p.i = k.i - 1 WHERE k.tag <> '' AND NOT closing), "
    "shown AS (SELECT k.page_id, k.i, w.ups, trim(regexp_replace(CASE WHEN x = chr(1) THEN bodies[body] ELSE "
    "replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') END, '\\s+', ' ', 'g')) AS v "
    "FROM kind k JOIN walk w ON w.page_id = k.page_id AND w.i = k.i WHERE k.tag = '' AND NOT regexp_matches(x, '^<[!?]')), "
    "path AS (SELECT s.page_id, s.i, '/' || coalesce(string_agg(n.tag || '[' || n.n || ']', '/' ORDER BY n.i), '') AS path, arg_max(n.tag, n.i) AS tag, arg_max(n.n, n.i) AS n "
    "FROM (SELECT page_id, i, unnest(CASE WHEN len(ups) = 0 THEN [-1] ELSE ups END) AS up FROM shown WHERE v <> '') s LEFT JOIN num n ON n.page_id = s.page_id AND n.i = s.up GROUP BY 1, 2)"
)


@query(
    "ext_html_paths", "doc_id bigint, ordinal int, text_hash varchar, path varchar, label varchar",
    "SELECT page_id AS doc_id, ordinal, substring(sha256(v), 1, 16) AS text_hash, path, CASE WHEN tag IS NULL THEN concat('HTML text ', ordinal) ELSE concat('HTML ', tag, ' ', n) END AS label FROM ("
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ordinal, v, path, tag, n FROM shown JOIN path USING (page_id, i)) x", _NODES,
)
def html_paths(spark, directory):
    pages = spread(table(spark, directory, "pages")).select(F.col("page_id").alias("doc_id"), "html")
    found = extract.extracted(pages, extract.html_texts(F.col("html")))
    return found.withColumn("text_hash", short_hash(F.col("fragment"), 16))
