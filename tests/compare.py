"""Compare a query with its SQL: column names, types, and rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# DuckDB type -> Spark type.
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def _rows(rows, order) -> Counter:
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = {name: TYPES.get(str(d[1]), str(d[1])) for name, d in zip(names, result.description)}
    mine = dict(df.dtypes)
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} != {sorted(theirs)}"
    wrong = {c: (mine[c], theirs[c]) for c in mine if mine[c] != theirs[c]}
    if wrong:
        return f"types (spark, sql): {wrong}"
    columns = sorted(mine)
    expected = _rows(result.fetchall(), [names.index(c) for c in columns])
    got = _rows(df.select(*[f"`{c}`" for c in columns]).collect(), range(len(columns)))
    if got != expected:
        extra, lacking = got - expected, expected - got
        return (
            f"{got.total()} rows, expected {expected.total()}; "
            f"extra {list(extra.items())[:2]}, lacking {list(lacking.items())[:2]}"
        )
    return None
