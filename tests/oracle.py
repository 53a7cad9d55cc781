"""Runs registered queries and their SQL statements side by side.

As a script: python -m tests.oracle [folder] [query ...]
"""

import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return value + 0.0
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=repr)


def compare(df, connection, statement):
    """Differences between a DataFrame and a statement, empty if there are none."""
    result = connection.execute(statement)
    expected_names = [d[0] for d in result.description]
    expected = _sorted_rows(expected_names, result.fetchall())
    actual = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    problems = []
    if actual[0] != expected[0]:
        problems.append(f"columns {actual[0]} != {expected[0]}")
    elif len(actual[1]) != len(expected[1]):
        problems.append(f"{len(actual[1])} rows != {len(expected[1])} rows")
    else:
        types = [(type(a).__name__, type(b).__name__) for x, y in zip(*[actual[1], expected[1]]) for a, b in zip(x, y)]
        for kinds in sorted(set(types)):
            if kinds[0] != kinds[1] and "NoneType" not in kinds:
                problems.append(f"types {kinds}")
    for mine, theirs in zip(actual[1], expected[1]):
        if mine != theirs:
            problems.append(f"{mine} != {theirs}")
            if len(problems) > 4:
                break
    return problems


def main():
    from tests.conftest import new_session

    import __spark_entry__ as driver

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, connection, oracles = new_session(), connect(folder), driver.oracle_sql()
    failed = []
    for name, run in driver.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problems = compare(df, connection, oracles[name])
                rows = ""
            else:
                rows = f"{len(df.collect())} rows"
                problems = []
        except Exception as error:
            problems, rows = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        verdict = "FAIL" if problems else ("ok" if name in oracles else "ran")
        print(f"{verdict:5} {time.time() - started:6.1f}s {name} {rows}", *problems[:4], sep="\n      " if problems else " ", flush=True)
        if problems:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")


if __name__ == "__main__":
    main()
