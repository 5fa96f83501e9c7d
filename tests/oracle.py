"""Holds a query's rows against its SQL on DuckDB: names, kinds and values, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "timestamp": {"TIMESTAMP"}, "date": {"DATE"}}


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else x
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") and getattr(x, "tzinfo", None) else x


def compare(df, con, sql):
    """None, or what differs."""
    names = sorted(df.columns)
    got = [[plain(r[n]) for n in names] for r in df.collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for n, k in df.dtypes:
        if k in KINDS and kinds[n] not in KINDS[k]:
            return f"{n}: {k} against {kinds[n]}"
    at = [rel.columns.index(n) for n in names]
    want = [[plain(r[i]) for i in at] for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{len(bad)} of {len(got)} rows differ, as {names}: {bad[:2]}"[:900] if bad else (None if got else "no rows")
