"""Compare a query with its SQL on the same Parquet files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def differences(spark, fn, sql, sf_dir, show=3):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = fn(spark, sf_dir)
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} != {sorted(rel.columns)}"
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    order = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=repr)
    if got == want:
        return None
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows, wanted {len(want)}; only Spark {sorted(a - b)[:show]}; only SQL {sorted(b - a)[:show]}"
