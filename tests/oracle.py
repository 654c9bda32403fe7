"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that compares equal across engines; floats keep all their digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return value
    return value


def spark_rows(df):
    order = sorted(df.columns)
    return order, [tuple(plain(r[c]) for c in order) for r in df.collect()]


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    at = [names.index(n) for n in order]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    rows = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    return order, kinds, rows


SAME_KIND = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
}


def differences(df, con, sql: str) -> str | None:
    """None where both sides agree, else what differs."""
    columns, rows = spark_rows(df)
    names, kinds, expected = duck_rows(con, sql)
    if columns != names:
        return f"columns {columns} != {names}"
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kinds[field.name] not in SAME_KIND.get(kind, {kinds[field.name]}):
            return f"type of {field.name}: {kind} != {kinds[field.name]}"
    if not rows:
        return "no rows"
    ours, theirs = Counter(rows), Counter(expected)
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{len(rows)} rows against {len(expected)}; {sum(extra.values())} differ, "
        f"e.g. {str(sorted(extra, key=str)[:1])[:1500]} against {str(sorted(missing, key=str)[:1])[:1500]}"
    )
