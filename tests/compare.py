"""Compare a Spark result with its SQL counterpart: columns, types, and rows in any order, exactly."""

from __future__ import annotations

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def canonical(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = [(n, _kind(table.schema.field(n).type)) for n in names]
    rows = list(zip(*[[_value(v) for v in table[n].to_pylist()] for n in names]))
    return kinds, sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return "timestamp" if pa.types.is_timestamp(t) else str(t)


def _value(v):
    return repr(v) if isinstance(v, float) else v


def differences(spark_frame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    got_kinds, got = canonical(spark_frame.toArrow())
    want_kinds, want = canonical(con.sql(sql).to_arrow_table())
    found = []
    if got_kinds != want_kinds:
        found.append(f"schema: {set(got_kinds) ^ set(want_kinds)}")
    if len(got) != len(want):
        found.append(f"rows: {len(got)} instead of {len(want)}")
    if not found:
        wrong = [(g, w) for g, w in zip(got, want) if g != w]
        if wrong:
            found.append(f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}")
    return found
