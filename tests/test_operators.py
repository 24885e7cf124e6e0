"""Operators on small fixed scenarios."""

from decimal import Decimal

from pyspark.sql import functions as F

from privasieve.functions import text as t
from privasieve.operators import anchors, delta, detect, evaluate, extract, findings, inventory, manage, redact
from privasieve.plans import finding_queries
from privasieve.sources import files


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_running_starts_over_many_blocks(spark):
    lengths = list(range(1000))
    row = spark.createDataFrame([(lengths,)], "n array<int>").select(t.running_starts(F.col("n")).alias("s")).first()
    assert row.s == [sum(lengths[:i]) for i in range(1000)]


def test_lines_like_splitlines(spark):
    text = "a\r\nb\x0bc\u2028d\n\ne\r"
    got = [(r.start, r.line) for r in one(spark, t.lines(F.col("text")), text)]
    expected, at = [], 0
    for raw in text.splitlines(keepends=True):
        expected.append((at, raw.rstrip("\r\n")))
        at += len(raw)
    assert got == expected


def test_fold(spark):
    assert one(spark, t.fold(F.col("text")), "  Führer_schein ＡＢＣ パスポート البريد الإلكتروني") == "fuhrer schein abc ハスホート البريد الالكتروني"


def test_delta_chain(spark):
    def files(**texts):
        rows = [(f"{k}.txt", v, len(v)) for k, v in texts.items()]
        return delta.fingerprints(spark.createDataFrame(rows, "path string, text string, size_bytes long"))

    def keys(*names):
        return spark.createDataFrame([(f"{n}.txt",) for n in names], "path string").select(findings.file_key(F.col("path")).alias("file_key"))

    first = files(unchanged="a@b.org", changed="c@d.org", removed="e@f.org")
    second = files(unchanged="a@b.org", changed="c@d.org more", new="g@h.org")
    compared = delta.compare(first, second)
    carried = delta.carried_findings(keys("unchanged", "changed", "removed"), compared)
    row = delta.delta_summary(compared, carried, keys("changed", "new")).first()
    assert (row.changed_files, row.new_files, row.modified_files, row.unchanged_files, row.missing_files) == (2, 1, 1, 1, 1)
    assert (row.carried_findings, row.processed_changed_files, row.missing_treated_as_deleted) == (1, 2, False)
    next_keys = delta.next_finding_keys(keys("unchanged", "changed", "removed"), compared, keys("changed", "new"))
    third = files(unchanged="a@b.org", changed="c@d.org more", new="g@h.org", second="i@j.org")
    again = delta.compare(second, third)
    row = delta.delta_summary(again, delta.carried_findings(next_keys, again), keys("second")).first()
    assert (row.changed_files, row.new_files, row.modified_files, row.unchanged_files) == (1, 1, 0, 3)
    assert row.carried_findings == 3


def test_context_is_redacted(spark):
    text = "intro Email: a@b.org; Card: secret, call +49 30 1234567 or Name: Jo Doe"
    docs = detect.with_signals(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for r in redact.context_windows(docs).collect():
        assert not any(raw in r.redacted_context for raw in ("a@b.org", "1234567", "Jo Doe", "secret"))
        # A span inside an earlier one has no marker of its own, so nothing is highlighted for it.
        marked = r.redacted_context[r.highlight_start : r.highlight_end]
        assert marked == "" or marked.startswith("[REDACTED_")
    masked = redact.masked_documents(docs).first().masked_text
    assert "a@b.org" not in masked and "Jo Doe" not in masked and masked.startswith("intro Email: [REDACTED_EMAIL]")


def test_leak_check_finds_leaks(spark):
    frame = spark.createDataFrame([("ok",), ("x a@b.org",), ("https://x",)], "v string")
    assert [r["rows"] for r in redact.leaks(frame).orderBy("pattern").collect()][:2] == [1, 1]


def test_safe_path(spark):
    for path, hidden in (("docs/a.txt", False), ("https://x/y", True), ("/srv/a", True), ("C:\\a", True), ("~/a", True), ("WWW.x.org", True)):
        assert one(spark, anchors.safe_path(F.col("text")), path).startswith("source_reference:") == hidden


def test_column_label(spark):
    labels = [one(spark, extract.column_label(F.lit(n)), "") for n in (1, 26, 27, 52, 702, 703)]
    assert labels == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]


def test_delimited_quotes_and_breaks(spark):
    text = 'Name;Note\n"a; ""b""";"two\nlines"\n;x'
    got = [f.text for f in one(spark, extract.delimited(F.col("text")), text)]
    assert got == ['Name: a; "b"', "Note: two\nlines", "Note: x"]


def test_json_order_and_errors(spark):
    assert [f.text for f in one(spark, extract.json_scalars(F.col("text")), '{"b": 1, "a": [true, null, "x"]}')] == ["b: 1", "a: true", "a: x"]
    assert one(spark, extract.json_scalars(F.col("text")), "{broken") is None


def test_json_of_any_depth(spark):
    deep = '{"a": [' * 30 + '1, {"b": "x"}' + "]}" * 30
    got = one(spark, extract.json_scalars(F.col("text")), deep)
    assert [(f.path, f.text) for f in got] == [("/field[1]/item[1]" * 29 + "/field[1]" + "/item[1]", "a: 1"), ("/field[1]/item[1]" * 29 + "/field[1]/item[2]/field[1]", "b: x")]
    assert [f.text for f in one(spark, extract.json_scalars(F.col("text")), '["{no json", {}, [], 2]')] == ["{no json", "2"]


def test_large_files_keep_their_text(spark, tmp_path):
    (tmp_path / "large.txt").write_text("a" * 1_200_000 + "@")
    (tmp_path / "small.txt").write_text("b")
    got = {r["name"]: r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["large.txt"].rejected == "unsupported" and got["large.txt"].text == "a" * 1_200_000 + "@"
    assert got["small.txt"].rejected is None and got["small.txt"].text == "b"


def test_evidence_beyond_the_top(spark):
    rows = [(1, i, "email_address", "d", 0.9, "[REDACTED_EMAIL]", i) for i in range(1, 8)]
    evidence = anchors.public_evidence(spark.createDataFrame(rows, "doc_id long, seq int, type string, detector string, confidence double, snippet string, line_number int"))
    assert [r.beyond_top for r in evidence.orderBy("seq").collect()] == [False] * 5 + [True] * 2
    assert findings.evidence_locations(evidence).first().locations == [f"Line {i}" for i in range(1, 8)]


def test_json_records(spark):
    got = one(spark, extract.json_scalars(F.col("text"), records=True), '{"a": 1}\n\n{"a": [2, 3]}\n')
    assert [(f.path, f.text) for f in got] == [("/record[1]/field[1]", "a: 1"), ("/record[2]/field[1]/item[1]", "a: 2"), ("/record[2]/field[1]/item[2]", "a: 3")]
    assert one(spark, extract.json_scalars(F.col("text"), records=True), '{"a": 1}\n{') is None


def test_delimiter_of_most_lines(spark):
    got = [f.text for f in one(spark, extract.delimited(F.col("text")), "Name, first;Mail\nA;b@x.org")]
    assert got == ["Name, first: A", "Mail: b@x.org"]


def test_xml_parts(spark):
    def texts(xml):
        found = one(spark, extract.xml_scalars(F.col("text")), xml)
        return found and [f.text for f in found]

    assert texts("<d><a><!--c-->mail@x.org</a><b><![CDATA[SSN 123-45-6789 <&amp;>]]></b></d>") == ["a: mail@x.org", "b: SSN 123-45-6789 <&amp;>"]
    assert texts('<?xml version="1.0"?><d xmlns="u" xmlns:p="x" p:id="7" a="x>y">v</d>') == ["id: 7", "a: x>y", "d: v"]
    for broken in ("<d><a>x</d>", "<d>x", "plain", ""):
        assert texts(broken) is None, broken


def test_html_entities_and_scripts(spark):
    text = "<p>A &amp; B &#233; &#x1F642;<!-- x --></p><script>if (a<b) t('</p>&amp;')</script>"
    assert [f.text for f in one(spark, extract.html_texts(F.col("text")), text)] == ["A & B é 🙂", "if (a<b) t('</p>&amp;')"]


def test_formats(spark):
    for name, kind, expected in (("a.PDF", "", "pdf"), ("a.bin", "video/mp4", "video_ocr"), ("a.log", "", "log"), ("a", "", "text"), ("a.exe", "", "unsupported"), ("a", "text/csv; charset=x", "csv"), (".txt", "", "text")):
        row = spark.createDataFrame([(name, kind)], "n string, k string").select(inventory.classify(F.col("n"), F.col("k")).alias("f")).first()
        assert row.f.file_format == expected, name


def test_decoding(spark):
    for raw, kind in (("é🙂x".encode(), ""), (b"\xef\xbb\xbf" + "é🙂x".encode(), ""), ("é🙂x".encode("utf-16"), ""), ("plain text é🙂x".encode("utf-16-le"), ""), ("é🙂x".encode("utf-16-be"), "text/plain; charset=UTF-16BE")):
        row = spark.createDataFrame([(bytearray(raw), kind)], "b binary, k string").select(inventory.decode_text(F.col("b"), F.col("k")).alias("t")).first()
        assert row.t.endswith("é🙂x"), raw


def test_scores_on_empty_input(spark):
    cases = spark.createDataFrame([(1, [], [])], "doc_id long, expected array<string>, actual array<string>")
    row = evaluate.micro_scores(evaluate.case_match(cases)).first()
    assert (row.precision, row.recall, row.f1) == (1.0, 1.0, 1.0)


def test_budget_is_a_prefix(spark):
    costs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(Decimal("0.01")).cast("decimal(18,10)").alias("cost"))
    rows = manage.tier_budget(costs, Decimal("2.5"), parts=7).orderBy("doc_id").collect()
    assert [r.admitted for r in rows] == [i < 250 for i in range(1000)]


def test_file_cap_is_exact_under_skew(spark):
    files = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source_id"), F.format_string("p%05d", "id").alias("path"))
    rows = inventory.file_cap(files, cap=3).filter("source_id = 'hot'").orderBy("path").collect()
    assert [r.path for r in rows] == ["p00000", "p00001", "p00002"]


def test_regions_in_rows_like_the_join(spark):
    """Overlapping, empty, enclosing and unordered regions, null ones, signals over stretches of 4096 and signals without any."""
    spans = [(9000, 9500), (0, 5000), (10, 20), (20, 20), (4090, 4100), (12, 15), (None, 30), (5000, None), (4096, 8192)]
    regions = [(1, i, a, b, i * 1.255, -i * 2.5, 10.0 + i, 4.0, None if i == 2 else 90.0 - i, f"u{i}") for i, (a, b) in enumerate(spans)]
    signals = [(1, 1, 14, 21), (1, 2, 9600, 9700), (1, 3, 4095, 4097), (1, 4, 20, 25), (1, 5, 0, 9001), (1, 6, 5000, 5001), (2, 1, 0, 5)]
    columns = "doc_id long, ordinal int, region_start int, region_end int, x double, y double, width double, height double, ocr_confidence double, unit string"
    r = spark.createDataFrame(regions, columns)
    s = spark.createDataFrame(signals, "doc_id long, seq int, start int, end int")
    expected = anchors.region_union(r.filter("region_start IS NOT NULL AND region_end IS NOT NULL"), s)
    arrays = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end"))).alias("signals")).join(
        r.groupBy("doc_id").agg(F.collect_list(F.struct(*r.columns[1:])).alias("regions")), "doc_id", "left")
    got = anchors.region_union_in_rows(arrays)
    assert got.schema.names == expected.schema.names
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in expected.collect()} and got.count() == 5


def _region_tables(spark, folder, texts):
    spark.createDataFrame([(i, "s", t) for i, t in texts], "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def test_region_union_sends_no_lines(spark, tmp_path):
    texts = [(1, "intro\nEmail: a@b.org\n\nName: Jo Doe"), (2, "nothing"), (3, None), (None, "Email: a@b.org")]
    once = finding_queries.region_union(spark, _region_tables(spark, tmp_path / "once", texts))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan and "Aggregate" not in plan and "signals" in plan and plan.count("Join") <= 1  # forms and nations
    assert {(r.doc_id, r.seq, r.regions) for r in once.collect()} == {(1, 1, 1), (1, 2, 1)}
    twice = finding_queries.region_union(spark, _region_tables(spark, tmp_path / "twice", [*texts, (1, "Email: c@d.org")]))
    assert sorted((r.doc_id, r.seq, r.regions) for r in twice.collect()) == [(1, 1, 4), (1, 2, 1)]
