"""Run a registered query and its check SQL side by side and compare the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def sort_key(row):
    return tuple((v is not None, str(v)) for v in row)


def compare(frame, con, sql: str) -> tuple[int, list[str]]:
    """Number of rows and a list of differences."""
    names = sorted(frame.columns)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    cursor = con.execute(sql)
    got = {d[0]: str(d[1]) for d in cursor.description}
    expected_rows = cursor.fetchall()
    problems = []
    if sorted(got) != names:
        return 0, [f"columns {names} against {sorted(got)}"]
    for name in names:
        wanted = KINDS.get(kinds[name], kinds[name])
        if got[name] != wanted:
            problems.append(f"type of {name}: {wanted} against {got[name]}")
    order = [list(got).index(n) for n in names]
    expected = sorted((tuple(normal(r[i]) for i in order) for r in expected_rows), key=sort_key)
    actual = sorted((tuple(normal(r[n]) for n in names) for r in frame.collect()), key=sort_key)
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} against {len(expected)}")
    missing = [r for r in expected if r not in set(actual)][:4] if actual != expected else []
    extra = [r for r in actual if r not in set(expected)][:4] if actual != expected else []
    if actual != expected:
        problems.append(f"values differ\n   only in SQL:   {missing}\n   only in Spark: {extra}\n   columns {names}")
    return len(actual), problems
