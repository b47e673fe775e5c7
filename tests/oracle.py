"""Compare a query with its SQL on DuckDB, the way the driver does: columns by name, rows in any order."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, bool):
        return v
    return v


def duck_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    kinds = [str(cur.description[k][1]) for k in order]
    return [names[k] for k in order], kinds, sorted((tuple(_plain(r[k]) for k in order) for r in cur.fetchall()), key=str)


def spark_rows(df):
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    return names, [kinds[n] for n in names], sorted((tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()), key=str)
