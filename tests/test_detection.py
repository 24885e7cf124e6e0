"""Detection against hand-written expectations."""

import random

import pytest
from pyspark.sql import functions as F

from privasieve.functions import fixed
from privasieve.functions.text import java_regex, lines, signs
from privasieve.operators import detect, labels, redact
from privasieve.plans import detection_queries

TEXTS = [
    "Name: Bob Miller\nEmail: u1@example.org\nPhone: +49 30 0000001",
    "Passport number\n\nC01X4567\n",
    "姓名 王芳 电话 13812345678\nFührerschein: B1234567",
    "Password=abc1; role=admin\nName: ____",
    "contact u4@example.org or 192.168.4.4, 4111 1111 1111 1111 300.1.1.1",
    "xpassenger name: Foo Bar\nEmail:",
    "confirmation: yes sir\nuser=jdoe token='ab c' x",
    "AB 12 34 56 C and 123-45-6789 at 10:15:30, https://example.org/users/5 ask @user_9",
    "Project budget: EUR 62000\nProduct SKU: AB12345678",
    "",
    "\n\n",
    "Nom: Claire Martin\nTéléphone: +33 6 12 34 56 78\nDate de naissance: 1988-04-02\nAdresse: 10 Rue Victor Hugo",
    "氏名：山田太郎　電話：03-1234-5678\r\nパスポート: TK1234567\x0b住所 東京都",
    "الاسم: أحمد علي\nالهاتف: 0501234567\nرقم الهوية: 1029384756",
    "Salary: EUR 50000 paid, expense USD 12.50 and budget USD 99",
    "call 5551234567 mobile; ref 1234567890123456 7; 2024-01-02 (030) 1234567",
    "étéa@b.fr éa@b.fr 7é12-34 \u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668 tel",
    "e-mail - a@b.org, DOB: 1990-01-01; Bank Account=DE12 3456 x, IBAN DE44500105175407324931",
    "Email\n\n\nlate@x.org\nSSN\nPassport\nAB123456\nSignature:\n  Jo Doe  ",
    "tax id: 12345678 vat id 99 88 77 66\n🙂 name = Zoë; 🙂 phone: +1 (843) 555-4223",
    "innovation: 12345\nsignificant: yes\nTeam name: Blue\nOwner: ACME Ltd\nDepartment: HR",
]


def found(spark, texts, limits=detect.Limits()):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = detect.detect_signals(rows, limits=limits).orderBy("doc_id", "seq").collect()
    by_doc = {i: [] for i in range(len(texts))}
    for r in out:
        by_doc[r.doc_id].append((r.type, r.snippet, r.start, r.end, r.line_number))
    return by_doc


# Types by text, read off the labels and values by hand.
TYPES = {
    0: {"person_name", "email", "phone_number"},
    1: {"passport_number"},
    3: {"credential_secret"},
    4: {"email", "online_identifier", "payment_card"},
    8: set(),
    9: set(),
    10: set(),
    11: {"person_name", "phone_number", "date_of_birth", "address"},
}


def test_types_of_texts(spark):
    got = found(spark, TEXTS)
    assert {i: {r[0] for r in got[i]} for i in TYPES} == TYPES


def test_positions_on_shuffled_parts(spark):
    rng = random.Random(7)
    parts = [p for t in TEXTS for p in t.replace("\n", " \n").split(" ") if p] + ["\n", ": ", "=", " - "]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n", ""]) for _ in range(30)) for _ in range(150)]
    for i, rows in found(spark, texts).items():
        assert all(0 <= start < end <= len(texts[i]) for _, _, start, end, _ in rows)


def test_bounds_are_optional(spark):
    names = "\n".join(f"Name {i}: Person{i} Example" for i in range(40))
    late = "x" * fixed.SCAN_CHARS + " late@example.org"
    whole = found(spark, [names, late])
    assert len(whole[0]) == 40 and len(whole[1]) == 1
    bounded = found(spark, [names, late], detect.BOUNDED)
    assert len(bounded[0]) == 32 and bounded[1] == []
    assert "Name 31: [REDACTED_PERSON_NAME]" in [s[1] for s in bounded[0]]
    assert "Name 32: [REDACTED_PERSON_NAME]" not in [s[1] for s in bounded[0]]


def test_long_documents_stay_linear(spark):
    lines = 30_000
    text = "".join(f"row {i} 10.0.{i % 256}.{i % 199} filler text\n" for i in range(lines))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert detect.rule_matches(rows, ["ipv4"]).count() == lines


@pytest.mark.parametrize("text", ["Budget 120 EUR", "SKU AB-12345678", "2024-01-02 10.12.2023", "batch 12345678901234567890"])
def test_clean_texts_give_nothing(spark, text):
    assert found(spark, [text])[0] == []


def test_no_shuffle_in_detection(spark):
    rows = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a@b.org").alias("text"))
    plan = detect.detect_signals(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_raw_values_never_leave(spark):
    for signals in found(spark, TEXTS).values():
        for _, snippet, *_ in signals:
            assert "@" not in snippet and not any(c.isdigit() for c in snippet.split("[")[-1])


def test_cheap_hints_find_what_the_whole_text_holds(spark):
    """Every cheap pattern that is in a text is in what is read of it for all rules at once."""
    far = "x" * 40
    parts = ["12", "AB12", "-123", "-12-", "12 34 56", ".1.", "-4abc-", "1" + " " * 30 + "2" * 12, "4111-1111 1111" + "-" * 20 + "1111", "50,  -7", "50," + " " * 30 + "-7", "1 ,\t9"]
    texts = [(i, text) for i, text in enumerate(t for p in parts for t in (p, far + p + far, f"{far}, {p} {far} 1", p + far + p))]
    frame = spark.createDataFrame(texts, "doc_id int, text string").withColumn("digits", detect.near_digits(F.col("text")))
    for name in detect._DIGIT_RULES:
        whole = F.col("text").rlike(java_regex(detect._RULES[name].needs))
        assert frame.filter(whole & ~detect._hinted(name, F.col("digits"), F.lit(True))).count() == 0, name


def test_lines_break_alike_with_and_without_rare_breaks(spark):
    texts = ["", "\n", "a\nb", "a\nb\n", "a\r\nb\r", "a\x0bb\x1cc\x85d", "a b c\n", "é\n\né"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: [(x.start, x.line) for x in r.ln] for r in rows.select("doc_id", lines(F.col("text")).alias("ln")).collect()}
    for i, text in enumerate(texts):
        at, expected = 0, []
        for line in text.splitlines(keepends=True):
            expected.append((at, line.rstrip("\r\n")))
            at += len(line)
        assert got[i] == expected, repr(text)


def test_kept_signals_are_kept_anew_after_the_cache_was_cleared(spark, tmp_path):
    spark.createDataFrame([(1, "src", "mail a@b.org")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "c_custkey long, c_name string, c_address string, c_nationkey long, c_phone string, c_acctbal double, c_mktsegment string, c_comment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([], "n_nationkey long, n_name string, n_regionkey long, n_comment string").write.parquet(f"{tmp_path}/nation.parquet")
    detection_queries.signals(spark, str(tmp_path))
    spark.catalog.clearCache()
    again = detection_queries.signals(spark, str(tmp_path))
    assert again.storageLevel.useMemory
    assert [(r.doc_id, r.type) for r in again.collect()] == [(1, "email")]


def test_runs_with_too_few_digits_are_no_phone_candidates(spark):
    """F4 to F21: a run of less than seven digits holds no valid phone number, so it is not searched for one."""
    texts = ["on 123 456 now", "tel 123 4567", "tel \u0661\u0662\u0663 \u0664\u0665\u0666\u0667"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = rows.select("doc_id", F.size(detect.phone_candidates(F.col("text"))).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in counted] == [0, 1, 1]


def test_ascii_texts_are_read_like_all_others(spark):
    """F4 to F21: texts of ASCII characters only have cheaper patterns; a wide character in a line of its own makes no difference."""
    texts = [t for t in TEXTS if t.isascii() and t.strip()]
    texts += ["\x1cname\x1f:\x0b\x1d Bob,;\t\x0b", "x_name: a\nname : ----\nName:\tn/a_\nUSER = 'a b' ; Role # KIS", "a" * 73 + ": b", "EMP-123: E-1234, -EE-99999999"]
    narrow, wide = found(spark, texts), found(spark, [t + "\n\u4e00" for t in texts])
    assert narrow == wide


@pytest.mark.parametrize("rule", fixed.PATTERN_RULES, ids=lambda r: r.name)
def test_ascii_regex_has_no_wide_class(rule):
    regex = java_regex(rule.pattern, rule.ignore_case, only_ascii=True)
    assert regex.isascii() and r"\p" not in regex and "(?iu)" not in regex


def test_signs_tell_of_a_text_what_the_text_tells(spark):
    """F7 to F20: digits, separators, breaks and letters of other scripts are looked for in what stays of a text without plain prose."""
    texts = TEXTS + ["Plain prose, it's all.\nNächste Zeile × ÷ ÿ", "a\x0bb", "a\x85b", "a b", "x – y", "tel ١", "my PassPort", "Key", "a：b", "only-one", "ſ passport"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("signs", signs(F.col("text")))
    told, text = F.col("signs"), F.col("text")
    pairs = [
        (labels.may_have_label(text), labels.may_have_label(text, told)),
        (text.rlike(r"\p{Nd}"), told.rlike(r"\p{Nd}")),
        (detect.near_digits(text), detect.near_digits(text, told)),
        (lines(text), lines(text, told)),
    ]
    for i, (whole, short) in enumerate(pairs):
        assert rows.filter(~whole.eqNullSafe(short)).count() == 0, i
    lost = rows.filter(text.rlike(detect._HEX_GROUP) & ~told.rlike("(?s)[:-].*[:-]")).count()
    assert lost == 0 and rows.filter("signs = ''").count() >= 3


def test_what_is_not_scrubbed_has_nothing_to_scrub(spark):
    """lines without at sign, colon or digit are left as they are; all others are scrubbed as before."""
    texts = TEXTS + ["plain; text, with | marks", "a\tb", "mail a@b.org, tel +49 30 1234567; name: Bob", "é 12345678 ١٢٣٤٥٦٧٨", "a： b; c", "x@y"]
    rows = spark.createDataFrame([(i, line) for i, t in enumerate(texts) for line in t.split("\n")], "doc_id int, line string")
    all_of_it = F.col("line")
    for pattern, marker in ((fixed.EMAIL, "EMAIL"), (fixed.PHONE, "PHONE"), (fixed.LONG_DIGITS, "NUMBER")):
        all_of_it = F.regexp_replace(all_of_it, java_regex(pattern), f"[REDACTED_{marker}]")
    assert rows.filter(~redact.scrub_numbers(F.col("line")).eqNullSafe(all_of_it)).count() == 0
    assert rows.filter(~redact.scrub_plain(F.col("line")).eqNullSafe(redact.scrub_labels(all_of_it))).count() == 0
    assert rows.filter(~F.col("line").rlike(redact._TO_SCRUB) & (redact.scrub_plain(F.col("line")) != F.col("line"))).count() == 0
