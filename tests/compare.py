"""Runs registered results on Spark and their SQL on DuckDB and compares names, types and rows.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import collections
import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


SQL_SECONDS = 0.0


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def differences(spark_df, con, sql: str, types: bool = True) -> list[str]:
    names = sorted(spark_df.columns)
    start = time.time()
    told = con.execute(sql)
    their = {d[0]: str(d[1]) for d in told.description}
    rows_b = told.fetchall()
    order_b = [d[0] for d in told.description]
    global SQL_SECONDS
    SQL_SECONDS = time.time() - start
    problems = []
    if names != sorted(order_b):
        return [f"columns differ: only spark {set(names) - set(order_b)}, only sql {set(order_b) - set(names)}"]
    for name, kind in spark_df.dtypes:
        expected = TYPES.get(kind, kind)
        if types and expected != their[name] and not their[name].endswith("[]"):
            problems.append(f"type of {name}: {kind} vs {their[name]}")
    rows_a = spark_df.select(*names).collect()
    index = [order_b.index(n) for n in names]
    a = collections.Counter(tuple(_cell(v) for v in row) for row in rows_a)
    b = collections.Counter(tuple(_cell(row[i]) for i in index) for row in rows_b)
    if a != b:
        left, right = list((a - b).elements()), list((b - a).elements())
        problems.append(f"rows {sum(a.values())} vs {sum(b.values())}; {len(left)} only spark, {len(right)} only sql")
        if left and right and len(names) > 0:
            key = min(left, key=repr)
            near = max(right, key=lambda r: sum(x == y for x, y in zip(r, key)))
            problems.append(str({n: (x, y) for n, x, y in zip(names, key, near) if x != y}))
        else:
            problems.append(f"spark {left[:2]} sql {right[:2]}")
    if not rows_a:
        problems.append("empty")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from encore.session import build_session

    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                found = differences(df, con, oracle[name])
            else:
                found = [] if df.count() else ["empty"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        mark = "FAIL" if found else ("ok" if name in oracle else "rows")
        print(f"{mark:5} {name} {time.time() - start:.1f}s (sql {SQL_SECONDS:.1f}s)", flush=True)
        for line in found:
            print("      ", line[:1800], flush=True)
    print(f"{bad} of {len(args.names or queries)} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
