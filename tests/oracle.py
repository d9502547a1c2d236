"""Rows of a query against rows of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), [tuple(r[i] for i in order) for r in got.fetchall()]


def said(rows) -> list[tuple]:
    return sorted(tuple("~" if v is None else repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows)


def assert_same(df, sql: str, folder: str) -> None:
    names, expected = rows_of_sql(sql, folder)
    assert sorted(df.columns) == names
    assert said(tuple(r) for r in df.select(*names).collect()) == said(expected)
