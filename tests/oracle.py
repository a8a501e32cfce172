"""Rows of a query and of its SQL on the same tables, for comparison."""

from pathlib import Path

import duckdb

TABLES = Path("/root/testdata/sf0.001")


def shown(v):
    return round(v, 7) if isinstance(v, float) else v


def both(spark, query, sql):
    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = query(spark, str(TABLES))
    cols = sorted(df.columns)
    ours = sorted(tuple(str(shown(r[c])) for c in cols) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(str(shown(r[names.index(c)])) for c in cols) for r in found.fetchall())
    return ours, theirs
