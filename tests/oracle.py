"""Compare a Spark result with DuckDB SQL over the same tables, whatever the order of rows and columns."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.9g}"
    return f"{v:.9g}" if isinstance(v, int) and abs(v) < 10**8 else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in rows)


def assert_same(df, sf_dir, sql):
    assert table(df.columns, df.collect()) == table(*rows_of(sf_dir, sql))
