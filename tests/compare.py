"""Rows of two engines, made comparable."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    ours = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(ours, key=key) == sorted(theirs, key=key)
