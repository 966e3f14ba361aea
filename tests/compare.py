"""Run a query and its SQL side by side and list the differences."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def kind(value) -> str:
    return "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def key(row) -> tuple:
    return tuple((v is None, str(kind(v)), str(v)) for v in row)


def differences(spark_df, con, sql: str, show: int = 3) -> list[str]:
    names = sorted(spark_df.columns)
    rows = spark_df.select(*[f"`{n}`" for n in names]).collect()
    left = sorted((tuple(plain(v) for v in row) for row in rows), key=key)
    relation = con.execute(sql)
    have = [c[0] for c in relation.description]
    if sorted(have) != names:
        return [f"columns {names} vs {sorted(have)}"]
    order = [have.index(n) for n in names]
    right = sorted((tuple(plain(row[i]) for i in order) for row in relation.fetchall()), key=key)
    out = []
    if len(left) != len(right):
        out.append(f"rows {len(left)} vs {len(right)}")
    bad = [(a, b) for a, b in zip(left, right)
           if a != b or [kind(v) for v in a] != [kind(v) for v in b]]
    if bad:
        out.append(f"{len(bad)} rows differ; columns {names}")
        out += [f"  spark {a}\n  sql   {b}" for a, b in bad[:show]]
    return out
