"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


#: Of a float: places that rows are put in order by, and the difference that is let pass.
PLACES, REL, ABS = 4, 1e-7, 1e-9


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rough(v):
    """A value to sort by: floats in few places, so that rows which differ in the last bits stand side by side."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, PLACES) + 0.0)
    return repr(tuple(rough(x) for x in v)) if isinstance(v, tuple) else repr(v)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return math.isclose(a, b, rel_tol=REL, abs_tol=ABS) or (math.isnan(a) and math.isnan(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return a == b


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = connect(sf_dir).sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    key = lambda row: [rough(v) for v in row]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if not same(a, b)]
    assert not wrong, wrong[:3]
