"""Rows of Spark and of the oracle as one form."""

from decimal import Decimal


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_as_sql(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == want
