"""Comparison of query results with DuckDB."""

import os

SF = "/root/testdata/sf0.001"


def oracle(sql, sf=SF):
    """Rows of DuckDB SQL over the driver's tables, by column."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con.execute(sql).df()


def same(a, b):
    """Equal pandas frames as bags of rows, whatever the order of columns and rows."""

    def norm(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=repr)

    assert sorted(a.columns) == sorted(b.columns)
    assert norm(a) == norm(b)
