"""Rows of Spark and DuckDB in one form, so that they can be compared without regard to order."""

import datetime
import decimal
import math


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([norm(r[c]) for c in names] for r in df.collect())


def duck_rows(rel):
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted([norm(r[i]) for i in at] for r in rel.fetchall())
