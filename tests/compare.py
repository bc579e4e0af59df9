"""Spark result against DuckDB result, row for row without order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

KINDS = {
    "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
}
TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t),
    )


def differences(df, con, sql: str, limit: int = 4) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    ours = df.collect()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    wrong = [(n, t, kinds[n]) for n, t in df.dtypes if t != kinds[n]]
    if wrong:
        return [f"types {wrong}"]
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a == b:
        return []
    out = [f"rows {len(a)} vs {len(b)}; columns {sorted(names)}"]
    left, right = list(a), set(b)
    out += [f"spark only {r}" for r in left if r not in right][:limit]
    mine = set(a)
    out += [f"sql only   {r}" for r in b if r not in mine][:limit]
    return out
