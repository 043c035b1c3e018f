"""Runs queries beside their SQL: ``python -m tests.parity FOLDER [NAME...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as entry
from loamgraph.session import build_session


def plain(v: object) -> object:
    """A value as both engines would show it."""
    if v is None or (not isinstance(v, (list, dict, bytes, bytearray)) and pd.isna(v)):
        return None
    if isinstance(v, float):
        return "inf" if math.isinf(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v.item() if hasattr(v, "item") else v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def compare(spark, sf_dir: str, name: str) -> str:
    """'' if equal, else what differs.  A query without SQL is never equal."""
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(mine)} rows, no SQL"
    columns, data = oracle(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    theirs = rows(columns, data)
    if mine == theirs:
        return ""
    a, b = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} and {len(theirs)} rows; only mine {a}; only SQL {b}"


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    session = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    for n in [q for q in entry.queries() if not names or any(q.startswith(x) for x in names)]:
        t = time.time()
        try:
            said = compare(session, folder, n) or "ok"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        print(f"{n:28} {time.time() - t:6.1f} s  {said}", flush=True)
