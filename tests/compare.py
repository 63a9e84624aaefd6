"""Run registered queries next to their SQL twins: ``python -m tests.compare [prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if value is None or isinstance(value, (str, bool, int)):
        return value
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(spark_df, con, sql: str, got=None) -> list[str]:
    """Empty when the Spark result and the SQL result are the same bag of rows."""
    relation = con.sql(sql)
    left_names, right_names = spark_df.columns, relation.columns
    if sorted(left_names) != sorted(right_names):
        return [f"columns {sorted(left_names)} != {sorted(right_names)}"]
    left = _rows(left_names, [tuple(r) for r in (spark_df.collect() if got is None else got)])
    right = _rows(right_names, relation.fetchall())
    problems = []
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)} rows")
    from collections import Counter

    a, b = Counter(left), Counter(right)
    problems += [f"only spark: {r}" for r in list((a - b).elements())[:4]]
    problems += [f"only sql:   {r}" for r in list((b - a).elements())[:4]]
    return problems


def main(prefixes: list[str], sf: str = "/root/testdata/sf0.01") -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    spark, con = make_session(), connect(sf)
    twins, failed = oracle_sql(), 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            df = query(spark, sf)
            if name in twins:
                got = df.collect()
                spark_s = time.time() - began
                problems, n = differences(df, con, twins[name], got), len(got)
            else:
                problems, n = [], df.count()
                spark_s = time.time() - began
        except Exception as problem:  # noqa: BLE001
            problems, n, spark_s = [str(problem)[:1500]], -1, 0.0
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} rows={n} spark {spark_s:.1f}s all {time.time() - began:.1f}s "
              f"{'' if name in twins else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:600], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
