"""Compare registered queries with their SQL twins: rows, column names, kinds and values."""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def normal(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def kind(name: str) -> str:
    low = name.lower()
    for word, k in (
        ("[]", "list"), ("array", "list"), ("list", "list"), ("bool", "bool"), ("timestamp", "timestamp"),
        ("date", "date"), ("bigint", "int"), ("int", "int"), ("long", "int"), ("hugeint", "huge"), ("decimal", "decimal"), ("double", "float"),
        ("float", "float"), ("varchar", "text"), ("string", "text"), ("blob", "binary"), ("binary", "binary"),
    ):
        if word in low:
            return "huge" if "hugeint" in low else k
    return low


def compare(con: duckdb.DuckDBPyConnection, df, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL result; empty when they agree."""
    return compare_rows(con, df, [tuple(r) for r in df.collect()], sql)


def compare_rows(con: duckdb.DuckDBPyConnection, df, rows: list[tuple], sql: str) -> list[str]:
    got_columns, got = normal(df.columns, rows)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: kind(str(d[1])) for d in result.description}
    want_columns, want = normal(names, result.fetchall())
    problems = []
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    for name, dtype in df.dtypes:
        if kind(dtype) != kinds[name]:
            problems.append(f"type of {name}: {dtype} != {kinds[name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        problems.append(f"values: only in Spark {extra}; only in SQL {missing}")
    return problems


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--dir", default="/root/testdata/sf0.001")
    parser.add_argument("--area")
    args = parser.parse_args()
    from fernweave import queries
    from fernweave.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.dir)
    oracles, bad = queries.all_oracles(), 0
    for name, run in queries.all_queries().items():
        area = queries.QUERIES[name].__module__.rsplit(".", 1)[1]
        if (args.names and name not in args.names) or (args.area and area not in args.area.split(",")):
            continue
        start = time.time()
        try:
            df = run(spark, args.dir)
            if name in oracles:
                rows = [tuple(r) for r in df.collect()]
                problems = compare_rows(con, df, rows, oracles[name])
                note = f"{len(rows)} rows " + " | ".join(problems)
            else:
                note = f"rows only: {df.count()}"
                problems = []
        except Exception as error:  # noqa: BLE001
            problems = [traceback.format_exc()[-1500:] if args.names else str(error)[:400]]
            note = problems[0]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {area}.{name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
