"""Run a query in Spark and its oracle in DuckDB and compare every value."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    return f"{type(value).__name__}:{value!r}"


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 5) -> list[str]:
    """An empty list when names, types and all values agree exactly."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(df.columns))}"]
    actual = [tuple(r) for r in df.collect()]
    left, right = _rows(df.columns, actual), _rows(names, expected)
    if left == right:
        return []
    out = [f"rows: spark {len(left)}, oracle {len(right)}"]
    ordered = sorted(names)
    extra = sorted(set(left) - set(right))
    missing = sorted(set(right) - set(left))
    out.append(f"unmatched: spark {len(extra)}, oracle {len(missing)}")
    for a, b in list(zip(extra, missing))[:limit]:
        out.append(str([(c, x, y) for c, x, y in zip(ordered, a, b) if x != y]))
    return out


def main() -> None:
    import time

    from martloom.catalog.oracle import all_oracles
    from martloom.catalog.queries import all_queries
    from martloom.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles = all_oracles()
    bad = 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                found = differences(df, con, oracles[name])
                note = f"{len(con.execute(oracles[name]).fetchall())} rows"
            else:
                found, note = [], f"{df.count()} rows, no oracle"
        except Exception as err:  # a report over all queries must go on
            found, note = [f"{type(err).__name__}: {str(err)[:1500]}"], ""
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - started:.1f}s {note}")
        for line in found:
            print("     ", line[:1500])
    print("failed:", bad)


if __name__ == "__main__":
    main()
