"""A query's rows against its SQL on the same tables, as the correctness gate compares them."""

import glob
import os

import duckdb


def compare(spark, folder, run, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want = want.fetchall()
    got = run(spark, folder)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    plain = lambda v: round(v, 9) if isinstance(v, float) else str(v)
    left = sorted(tuple(map(plain, (r[c] for c in order))) for r in got.collect())
    right = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in want)
    assert left == right, (len(left), len(right), [x for x in zip(left, right) if x[0] != x[1]][:3])
    return len(left)
