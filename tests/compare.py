"""Row-by-row comparison of a Spark result with DuckDB on the same tables."""

from pathlib import Path

import duckdb


def cell(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "null"
    name = type(v).__name__
    if name.startswith(("bool",)):
        return str(bool(v))
    if name.startswith(("float", "int", "Decimal")):
        v = round(float(v), 5) + 0.0
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None))


def duck(sql, sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con.sql(sql).df()


def check(df, sql, sf_dir):
    a, b = rows(df.toPandas()), rows(duck(sql, sf_dir))
    assert a[0] == b[0]
    assert a[1] == b[1]
