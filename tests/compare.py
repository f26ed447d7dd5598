"""Queries against their SQL on the same tables."""

import glob
import math
import os


def rows_of(result, names):
    out = []
    for r in result:
        row = []
        for v in (r[n] for n in names):
            row.append(None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v)
        out.append(tuple(row))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    cur = duck(sf).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = rows_of([dict(zip(names, r, strict=True)) for r in cur.fetchall()], names)
    got = rows_of([r.asDict() for r in df.collect()], names)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (names, len(bad), bad[:3])
    return len(got)
