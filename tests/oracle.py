"""Holds catalogue queries against their SQL: same rows, same columns, compatible types."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else (0.0 if x == 0 else float(repr(x)))
    if isinstance(x, list | tuple):
        return tuple(_plain(v) for v in x)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "float": {"FLOAT"}, "timestamp": {"TIMESTAMP"}, "date": {"DATE"}}


def mismatch(df, con, sql: str) -> str | None:
    """None where both sides agree, else what differs."""
    rel = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in rel.description}
    names, want = _rows([d[0] for d in rel.description], rel.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns {got_names} and {names}"
    wrong = {c: (k, kinds[c]) for c, k in df.dtypes if k in KINDS and kinds[c].upper() not in KINDS[k] and kinds[c].upper() not in ("NUMBER", "STRING", "BOOL")}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, such as {bad[0]}" if bad else None
