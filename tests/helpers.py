"""Comparing a Spark result with a DuckDB result, whatever the order of rows."""

import math


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return None
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None))


def same(df, con, sql):
    got, want = rows_of(df.toPandas()), rows_of(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
