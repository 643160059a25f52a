"""A query's rows against DuckDB's for its SQL."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*(f"`{n}`" for n in names)).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))


def expected(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql).df()
    got = got[sorted(got.columns)].astype(object)
    return list(got.columns), sorted(map(repr, got.where(got.notna(), None).itertuples(index=False, name=None)))
