"""A query's rows against DuckDB's for its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


def same(df, sql, con):
    got = df.select(*sorted(df.columns)).collect()
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    rows = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    assert plain(got) == plain(rows)
