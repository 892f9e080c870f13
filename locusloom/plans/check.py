"""Run registered queries beside their SQL in DuckDB and compare the rows.

``python -m locusloom.plans.check [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = build(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if repr(a) != repr(b):  # also tells 1 from 1.0 and 0.0 from -0.0
            return f"{left[0]}: {a} != {b}"
    return None


def main(args: list[str]) -> int:
    from locusloom.plans import catalog
    from locusloom.session import build_session

    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    names = args[1:] or list(catalog.QUERIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name in names:
        started = time.time()
        try:
            if name in catalog.ORACLE:
                problem = compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf_dir)
            else:
                n = len(catalog.QUERIES[name](spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failures} of {len(names)} equal")
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
