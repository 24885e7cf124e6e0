"""Compare registered queries with their check SQL: python -m tests.check [name or prefix ...]"""

from __future__ import annotations

import os
import sys
import time

from tests.oracle import compare, connect
from tests.session import session


def main(wanted: list[str]) -> int:
    import __spark_entry__ as entry

    directory = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    con = connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            frame = run(spark, directory)
            if name in oracles:
                rows, problems = compare(frame, con, oracles[name])
            else:
                rows, problems = len(frame.collect()), []
        except Exception as error:  # report and go on with the next query
            rows, problems = 0, [f"{type(error).__name__}: {str(error)[:1500]}"]
        if rows == 0 and not problems:
            problems = ["no rows"]
        state = "ok " if not problems else "BAD"
        kind = "sql " if name in oracles else "rows"
        print(f"{state} {kind} {name} rows={rows} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            bad += 1
            print("    ", problem, flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
