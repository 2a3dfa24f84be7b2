"""Run registered queries next to their SQL on DuckDB and compare schema, rows and values.

``python -m lectern.workloads.check [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_", "").replace("string_view", "string")


def _canon(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    if isinstance(value, list):
        return "[" + ",".join(_canon(v) for v in value) + "]"
    return repr(value)


def compare(left, right) -> str | None:
    """None when two Arrow tables agree, else what differs."""
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return f"columns {names} / {sorted(right.column_names)}"
    kinds = [(n, _kind(left.schema.field(n).type), _kind(right.schema.field(n).type)) for n in names]
    bad = [k for k in kinds if k[1] != k[2]]
    if bad:
        return f"types {bad}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} / {right.num_rows}"
    rows = lambda t: Counter(zip(*[[_canon(v) for v in t.column(n).to_pylist()] for n in names]))
    a, b = rows(left), rows(right)
    if a != b:
        return f"values {names}\n   spark {list((a - b).items())[:2]}\n   sql   {list((b - a).items())[:2]}"[:1500]
    return None


def main(argv: list[str]) -> int:
    import duckdb

    from lectern.plans.session import local_session
    from lectern.workloads import all_queries, all_sql

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = all_queries(), all_sql()
    wanted = argv[1:] or list(queries)
    spark = local_session(8)
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            got = queries[name](spark, sf).toArrow()
            took = time.time() - start
            if name in sql:
                expected = duck.execute(sql[name]).to_arrow_table()
                problem = compare(got, expected)
            else:
                problem = None if got.num_rows else "no rows"
            note = "" if name in sql else " (rows only)"
            print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} rows={got.num_rows} {took:.2f}s" + (f" {problem}" if problem else ""), flush=True)
            failed += problem is not None
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
