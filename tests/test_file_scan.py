"""A tree of files of all text formats, from bytes on disk to signals with their places."""

from __future__ import annotations

import pytest

from privasieve.plans import file_scan
from privasieve.sources import files

TREE = {
    "table.csv": "Name;Mail\nJo;a@b.org",
    "pairs.csv": "Field,Value\nMail,a@b.org",
    "data.json": '{"x": ["[1]", {"mail": "a@b.org"}], "x2": 1}',
    "rows.ndjson": '{"m": "a@b.org"}',
    "tree.xml": '<?xml version="1.0"?><d><p id="a@b.org"/></d>',
    "page.html": "<html><body><p>hi</p><p>mail <b>a@b.org</b></p></body></html>",
    "notes.md": "# Title\n\n| Name | Mail |\n| --- | --- |\n| Jo | a@b.org |",
    "plain.txt": "one\ntwo a@b.org\n",
    "talk.vtt": "WEBVTT\n\n1\n00:00 --> 00:01\nsay a@b.org",
    "README": "mail a@b.org",
    "deep/inner.txt": "x a@b.org",
    "second.csv": "Name;Mail\nJo;x\n\n;c@d.org",
    "second.ndjson": '{"m": "x"}\n{"m": "c@d.org"}',
    "second.xml": "<d><p id='x'/><p>write  c@d.org</p></d>",
    "second.html": "<html><body><p>hi</p><p>mail <b>x</b> or c@d.org</p></body></html>",
    "second.md": "# Title\n\n| Name | Mail |\n| --- | --- |\n| Jo | x |\n\n   ask c@d.org",
    "broken.json": '{"a": "a@b.org"',
    "broken.xml": "<d>a@b.org",
    "blank.txt": "  \n",
    "binary": "\x00\x01\x02\x03\x04\x05a@b.org",
    "scan.pdf": "%PDF a@b.org",
}
PLACES = {
    ("table.csv", "a@b.org", "tableCell", "2,2", "row 2 column B", None, None, 0),
    ("second.csv", "c@d.org", "tableCell", "4,2", "row 4 column B", None, None, 0),
    ("pairs.csv", "a@b.org", "tableCell", "2,2", "row 2 column B", None, None, 0),
    ("data.json", "a@b.org", "structurePath", "/field[1]/item[2]/field[1]", "JSON field 1.1", None, None, 0),
    ("rows.ndjson", "a@b.org", "structurePath", "/record[1]/field[1]", "NDJSON record 1 field 1", None, None, 0),
    ("second.ndjson", "c@d.org", "structurePath", "/record[2]/field[1]", "NDJSON record 2 field 1", None, None, 0),
    ("tree.xml", "a@b.org", "structurePath", "/element[1]/element[1]/attribute[1]", "XML element 1.1 attribute 1", None, None, 0),
    ("second.xml", "c@d.org", "structurePath", "/element[1]/element[2]", "XML element 1.2", None, None, 6),
    ("page.html", "a@b.org", "structurePath", "/html[1]/body[1]/p[2]/b[1]", "HTML b 1", None, None, 0),
    ("second.html", "c@d.org", "structurePath", "/html[1]/body[1]/p[2]", "HTML p 2", None, None, 3),
    ("notes.md", "a@b.org", "tableCell", "5,2", "row 5 column B", None, None, 0),
    ("second.md", "c@d.org", "textPosition", None, "Line 7", 7, 8, 4),
    ("plain.txt", "a@b.org", "textPosition", None, "Text content", 2, 5, 8),
    ("talk.vtt", "a@b.org", "textPosition", None, "Transcript text", 1, 5, 4),
    ("README", "a@b.org", "textPosition", None, "Detected text content", 1, 6, 5),
    ("inner.txt", "a@b.org", "textPosition", None, "Text content", 1, 3, 2),
}
FAILURES = {
    ("broken.json", "json", "malformed", "unsupported"), ("broken.xml", "xml", "malformed", "unsupported"), ("blank.txt", "txt", "no_text", "hard"),
    ("binary", "text", "unsupported", "unsupported"), ("scan.pdf", "pdf", "unsupported", "moderate"),
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return file_scan.scan_files(files.read_texts(spark, str(root)))


def test_signals_and_failures(scanned):
    rows = scanned.collect()
    assert len(rows) == len(TREE)
    found = {
        (r.name, r.extracted_text[s.start : s.end], s.selector, s.path, s.label, s.line, s.column, s.source_start)
        for r in rows for s in r.located if s.type == "email"
    }
    assert found == PLACES
    assert {(r.name, r.file_format, r.issue, r.difficulty) for r in file_scan.failure_rows(scanned, "name").collect()} == FAILURES
    assert all(s.source_end - s.source_start == s.end - s.start for r in rows for s in r.located if s.source_start is not None)


def test_no_exchange(scanned):
    assert "Exchange" not in scanned._jdf.queryExecution().executedPlan().toString()
