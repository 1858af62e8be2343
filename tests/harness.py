"""Run registered queries next to their oracle SQL and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle_connection(path):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def oracle_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def difference(spark, con, query, path):
    """None when they agree, else a short account of how they differ."""
    sc, sr = spark_rows(query.run(spark, path))
    oc, orows = oracle_rows(con, query.sql)
    if sc != oc:
        return f"columns {sc} != {oc}"
    if sr != orows:
        only_s = [r for r in sr if r not in set(orows)][:3]
        only_o = [r for r in orows if r not in set(sr)][:3]
        return f"{len(sr)} rows vs {len(orows)}; spark only {only_s}; oracle only {only_o}"
    return None
