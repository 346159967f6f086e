"""Compares a query with its DuckDB SQL on the same tables, whatever the order of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list) else "null" if v is None else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[[plain(v) for v in table.column(c).to_pylist()] for c in names], strict=True))
