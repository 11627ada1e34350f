"""Rows of Spark and of SQL in a form that can be compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def sql_rows(query, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(query)
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
