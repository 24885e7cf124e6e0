"""Extraction by hand: JSON strings and repeated keys, paths of HTML nodes, references, and time that follows the input."""

from __future__ import annotations

import html
import json
import time

from pyspark.sql import functions as F

from privasieve.functions import text as T
from privasieve.operators import extract


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "text string").select(expression.alias("x")).first().x


def json_of(spark, text, **options):
    found = one(spark, extract.json_scalars(F.col("text"), **options), text)
    return found and [(f.text, f.path, f.label) for f in found]


def test_json_strings_are_scalars(spark):
    assert json_of(spark, '{"note":"[1, 2]", "o": "{\\"a\\": 1}"}') == [
        ("note: [1, 2]", "/field[1]", "JSON field 1"), ('o: {"a": 1}', "/field[2]", "JSON field 2")]
    assert json_of(spark, ' "alone" ') == [("alone", "/value", "JSON field value")]
    assert json_of(spark, '{"k\\u00e9\\n:": "a\\"b\\\\c,}"}') == [("ké\n:: a\"b\\c,}", "/field[1]", "JSON field 1")]
    assert json_of(spark, "[]") == [] and json_of(spark, '{"a": null, "b": " "}') == []
    assert json_of(spark, "7") == [("7", "/value", "JSON field value")]


def test_json_repeated_keys(spark):
    assert json_of(spark, '{"a":1,"b":2,"a":{"c":3}}') == [("c: 3", "/field[1]/field[1]", "JSON field 1.1"), ("b: 2", "/field[2]", "JSON field 2")]
    for broken in ("{broken", '{"a":1', '{"a":1}}', "", "[1,]", '{"a" 1}', "[1] 2"):
        assert json_of(spark, broken) is None, broken


def test_json_labels_of_items_and_records(spark):
    assert json_of(spark, '{"t": [["x", {"y": "z"}], "w"]}') == [
        ("t: x", "/field[1]/item[1]/item[1]", "JSON field 1"), ("y: z", "/field[1]/item[1]/item[2]/field[1]", "JSON field 1.1"), ("t: w", "/field[1]/item[2]", "JSON field 1")]
    assert json_of(spark, '{"a": {"b": "[x"}}\n\n["q"]', records="ndjson") == [
        ("b: [x", "/record[1]/field[1]/field[1]", "NDJSON record 1 field 1.1"), ("q", "/record[2]/item[1]", "NDJSON record 2 field value")]
    assert json_of(spark, '{"a": 1, "a": 2}\n{"b": 1}', records="jsonl") == [("a: 2", "/record[1]/field[1]", "JSONL record 1 field 1"), ("b: 1", "/record[2]/field[1]", "JSONL record 2 field 1")]
    assert json_of(spark, '[1\n2]', records="jsonl") is None


def html_of(spark, text):
    return [(f.text, f.path, f.label) for f in one(spark, extract.html_texts(F.col("text")), text)]


def test_html_paths(spark):
    assert html_of(spark, "<p>one <b>two</b> tail</p>end") == [
        ("one", "/p[1]", "HTML p 1"), ("two", "/p[1]/b[1]", "HTML b 1"), ("tail", "/p[1]", "HTML p 1"), ("end", "/", "HTML text 4")]
    got = html_of(spark, "<div><p>a</p><p>b<br>c</p></div><div><p>d</p>e<img src='x'/>f</div>")
    assert got == [
        ("a", "/div[1]/p[1]", "HTML p 1"), ("b", "/div[1]/p[2]", "HTML p 2"), ("c", "/div[1]/p[2]/br[1]", "HTML br 1"),
        ("d", "/div[2]/p[3]", "HTML p 3"), ("e", "/div[2]", "HTML div 2"), ("f", "/div[2]", "HTML div 2")]
    assert html_of(spark, "<a><b>x</c>y<b>z") == [("x", "/a[1]/b[1]", "HTML b 1"), ("y", "/", "HTML text 2"), ("z", "/b[1]", "HTML b 1")]
    assert html_of(spark, "") == [] and html_of(spark, "<!-- x -->") == []


def test_html_references(spark):
    for text in ("&eacute;t&eacute", "a &amp b &ampx; &notit; &unknown; &lt&gt", "&#65;&#x42&#67 &#128; &#0; &#xD800;", "&copy2 &nbsp;|", "100% & more &;"):
        expected = " ".join(html.unescape(text).split())
        assert one(spark, T.collapse(extract.decode_entities(T.searchable(F.col("text")))), text) == expected, text


def test_blocks_and_merges(spark):
    starts = [0, 5, 5, 9, 400]
    positions = sorted([0, 1, 4, 5, 6, 9, 10, 399, 400, 10_000])
    frame = spark.createDataFrame([(starts, positions, [None, 1, None, 2, None], [])], "s array<int>, p array<int>, v array<int>, e array<int>")
    row = frame.select(T.preceding(F.col("s"), F.col("p")).alias("p"), T.latest(F.col("v")).alias("v"), T.preceding(F.col("e"), F.col("p")).alias("none"), T.latest(F.col("e")).alias("e")).first()
    assert row.p == [max(i for i, s in enumerate(starts) if s <= p) for p in positions]
    assert row.v == [None, 1, 1, 2, 2] and row.e == [] and set(row.none) == {-1}


def seconds(frame, expression):
    started = time.perf_counter()
    frame.select(F.size(expression)).collect()
    return time.perf_counter() - started


def test_time_follows_the_input(spark):
    """Four times the input takes less than seven times as long."""
    parts = {
        "json": (lambda n: json.dumps([{"id": i, "mail": f"u{i}@x.org", "tags": ["a", {"b": "[c"}]} for i in range(n)]), extract.json_scalars(F.col("text"))),
        "xml": (lambda n: "<d>" + "".join(f'<r id="{i}"><m>u{i}@x.org</m><e/></r>' for i in range(n)) + "</d>", extract.xml_scalars(F.col("text"))),
        "html": (lambda n: "<html><body>" + "".join(f"<div><p>u{i}@x.org<br>b</p></div>" for i in range(n)) + "</body></html>", extract.html_texts(F.col("text"))),
    }
    for name, (make, expression) in parts.items():
        small, large = (spark.createDataFrame([(make(n),)], "text string").cache() for n in (2000, 8000))
        assert small.count() == large.count() == 1
        seconds(small, expression)
        assert seconds(large, expression) < 7 * seconds(small, expression) + 0.5, name
