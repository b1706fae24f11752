"""Results of a query and of its SQL, in a form that can be compared."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x if x is None or isinstance(x, (int, str)) else float(x) if x.__class__.__name__ == "Decimal" else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


def of_sql(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows(names, got.fetchall())


def of_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())
