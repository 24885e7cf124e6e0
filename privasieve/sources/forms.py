"""Form documents rendered from customer rows.

Plain prose rarely holds labelled personal data, so one form is rendered per customer, in sixteen
shapes. The expression uses only functions with the same meaning in every SQL dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_FORM_ID = 1_000_000_000


def _pad(value: str, width: int) -> str:
    return f"lpad(concat({value}, ''), {width}, '0')"


def _lines(*parts: str) -> str:
    return "concat(" + ", chr(10), ".join(parts) + ")"


_NAMES = "concat(" + ", chr(10), ".join(
    f"'Name {i}: Person{i} of ', {_pad('k', 6)}" for i in range(40)
) + ")"

FORM_SHAPES = (
    _lines("'Project budget: EUR 62000'", "'Product SKU: AB12345678'"),
    _lines("concat('Name: ', c_name)", "concat('Email: u', k, '@example.org')",
           f"concat('Phone: +49 30 ', {_pad('k', 7)})"),
    _lines(f"concat('Employee ID: EMP-', {_pad('k', 5)})", "concat('Salary: EUR ', 10000 + k % 90000)"),
    "concat('contact u', k, '@example.org or 192.168.', k % 256, '.', k % 199)",
    _lines(f"concat('transfer to DE', {_pad('k % 97', 2)}, {_pad('k', 18)}, ' soon')",
           f"concat('our tax id DE', {_pad('k', 9)})"),
    _lines(f"concat('on file ', {_pad('k % 1000', 3)}, '-', {_pad('k % 97', 2)}, '-', {_pad('k', 4)})",
           f"concat('and AB ', {_pad('k % 100', 2)}, ' ', {_pad('k % 97', 2)}, ' ', {_pad('k % 89', 2)}, ' C')"),
    _lines(f"concat('seen 0a:1b:2c:3d:', {_pad('k % 89', 2)}, ':ff')",
           f"concat('visitor ', {_pad('k', 8)}, '-0000-4000-8000-', {_pad('k', 12)})"),
    _lines("concat('expense claim USD ', k % 9999, '.50')",
           "'The yearly plan of the whole office was settled long before the summer break.'",
           "'Later on the board saw a budget of USD 120 in total'"),
    _lines("concat('see https://example.org/users/', k)", "concat('or https://example.org/docs/', k)"),
    _lines("concat('ask @user_', k)", "concat('mail a@user.n', k, '.org')"),
    _lines(f"concat('at 52.52', {_pad('k % 99', 2)}, ', 13.40', {_pad('k % 99', 2)})",
           f"concat('on 10:15:', {_pad('k % 60', 2)})"),
    _lines("'Passport number'", "''", f"concat('C01X', {_pad('k', 4)})"),
    _lines(f"concat('姓名 王芳 电话 138', {_pad('k', 8)})", f"concat('Führerschein: B', {_pad('k', 7)})"),
    _lines("'host 300.1.1.1 down'", "'paid with 4111 1111 1111 1111'",
           f"concat('ref 1234 5678 ', {_pad('k', 8)})"),
    _NAMES,
    _lines("concat('Password=abc', k, '; role=admin')", "'Name: ____'", "concat('confirmation: yes ', k)"),
)

FORM_TEXT = "case k % 16 " + " ".join(
    f"when {i} then {shape}" for i, shape in enumerate(FORM_SHAPES)
) + " end"


def render_forms(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """One form per customer: doc_id, source (the nation), text."""
    named = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    return named.withColumn("k", F.col("c_custkey")).select(
        (F.col("k") + FIRST_FORM_ID).alias("doc_id"),
        F.col("n_name").alias("source"),
        F.expr(FORM_TEXT).alias("text"),
    )
