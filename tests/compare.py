"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat(timespec="microseconds")
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        f = float(x)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, duck_connection, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    c = duck_connection.execute(sql)
    names = [d[0] for d in c.description]
    expected = rows_of(names, c.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != expected:
        a, b = set(got) - set(expected), set(expected) - set(got)
        return f"rows {len(got)} and {len(expected)}; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
    return ""
