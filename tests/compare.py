"""Runs registered queries beside their SQL counterparts and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shardloom.sources.views import TABLES  # noqa: E402


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def check(spark, con, sf_dir, function, sql):
    """None when equal, else a short description of the difference."""
    df = function(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows_of(names, result.fetchall())
    if got == want:
        kinds = {n: str(t) for n, t in zip(names, [d[1] for d in result.description], strict=True)}
        spark_kinds = dict(df.dtypes)
        same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}
        odd = {n: (spark_kinds[n], kinds[n]) for n in names if same.get(spark_kinds[n], spark_kinds[n]) != kinds[n]}
        return f"types {odd}" if odd else None
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"{len(got)} rows != {len(want)}; {sorted(df.columns)}; first {diff}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = oracle(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, function in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            problem = check(spark, con, sf_dir, function, sqls.get(name))
        except Exception as error:  # the list of failures is the result
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - began:.1f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
