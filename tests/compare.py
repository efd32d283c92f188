"""Run registered queries against their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.date() if value.time() == dt.time(0) else value
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: [(v is not None, str(v)) for v in r])


def compare(spark, folder: str, name: str, run, sql: str | None) -> dict:
    started = time.time()
    frame = run(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    out = {"name": name, "rows": len(got), "sec": round(time.time() - started, 2)}
    if sql is None:
        return {**out, "ok": len(got) > 0, "how": "rows"}
    started = time.time()
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    out["sql_sec"] = round(time.time() - started, 2)
    same_names = sorted(frame.columns) == sorted(names)
    out |= {"ok": same_names and got == want, "how": "sql", "want_rows": len(want)}
    if not out["ok"]:
        out["columns"] = (sorted(frame.columns), sorted(names)) if not same_names else None
        gs, ws = set(map(str, got)), set(map(str, want))
        out["only_spark"] = [r[:300] for r in sorted(gs - ws)[:3]]
        out["only_sql"] = [r[:300] for r in sorted(ws - gs)[:3]]
    return out


if __name__ == "__main__":
    import __spark_entry__ as contract
    from tidemark.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    oracles, bad = contract.oracle_sql(), []
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            out = compare(spark, folder, name, run, oracles.get(name))
        except Exception as error:  # report and go on
            out = {"name": name, "ok": False, "error": f"{type(error).__name__}: {str(error)[:600]}"}
        short = {k: out[k] for k in ("name", "rows", "sec", "how") if k in out}
        print("OK " if out["ok"] else "BAD", short if out["ok"] else out, flush=True)
        if not out["ok"]:
            bad.append(name)
    print("FAILED:", bad)
